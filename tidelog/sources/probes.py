"""What a source can be asked: its head, its lag, its tables and their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import fingerprint


def head(log: DataFrame) -> DataFrame:
    """The highest LSN, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("head"))


def lag_bytes(current: Column, confirmed: Column) -> Column:
    return F.greatest(F.coalesce(current - confirmed, F.lit(0)), F.lit(0))


def exists(names: DataFrame, column: str, name: str) -> DataFrame:
    return names.where(F.col(column) == name).agg((F.count(F.lit(1)) > 0).alias("found"))


def publication_tables(log: DataFrame) -> DataFrame:
    """The tables of a log, sorted."""
    return log.select(F.col("table.schema").alias("schema"), F.col("table.table").alias("table")).distinct().orderBy("schema", "table")


def catalog(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each column of each ``schema.table``; names of another form are left out."""
    keys, rows = keys or {}, []
    for name, table in tables.items():
        parts = name.split(".")
        if len(parts) != 2:
            continue
        print_ = fingerprint(parts[0], parts[1], [(f.name, f.dataType.simpleString()) for f in table.schema])
        for k, f in enumerate(table.schema):
            rows.append((*parts, f.name, f.dataType.simpleString(), f.nullable, f.name in keys.get(name, []), k + 1, print_))
    kind = "schema string, table string, name string, type_name string, is_nullable boolean, is_primary_key boolean, ordinal_position int, fingerprint string"
    return spark.createDataFrame(rows, kind)

"""Publications: what a source sends, and how a configured one differs from a live one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PublishedTable:
    name: str
    ops: tuple[str, ...] = ()
    where: str | None = None
    columns: tuple[str, ...] | None = None


def scan(source: DataFrame, table: PublishedTable) -> DataFrame:
    """A source table as published: its row filter and columns reach the scan."""
    rows = source.where(F.expr(table.where)) if table.where else source
    return rows.select(*table.columns) if table.columns is not None else rows


def as_frame(spark: SparkSession, tables: list[PublishedTable]) -> DataFrame:
    rows = [(t.name, ",".join(sorted(t.ops)), t.where, ",".join(t.columns) if t.columns is not None else None) for t in tables]
    return spark.createDataFrame(rows, "table string, ops string, predicate string, columns string")


def diff(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """(table, action): add, drop, alter (operations, filter or columns differ) or keep."""
    facts = [c for c in wanted.columns if c != "table"]
    other = live.select(F.col("table").alias("table_"), *[F.col(c).alias(c + "_") for c in facts])
    joined = wanted.join(other, F.col("table") == F.col("table_"), "full_outer")
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(c + "_"))
    action = F.when(F.col("table_").isNull(), "add").when(F.col("table").isNull(), "drop").when(same, "keep").otherwise("alter")
    return joined.select(F.coalesce("table", "table_").alias("table"), action.alias("action"))


def reconcile(actions: dict[str, str], exists: bool, managed: bool) -> list[str]:
    """What a reconciler does: create, nothing, alter table by table, or leave an external publication alone."""
    if not managed:
        return ["skip external publication"]
    if not exists:
        return ["create publication"]
    return [f"{action} {table}" for table, action in sorted(actions.items()) if action != "keep"]


def list_diff(wanted: DataFrame, live: DataFrame, name: str = "name") -> DataFrame:
    """(side, name): the names that are wanted and not live ("added"), and those that are live and not wanted ("removed")."""
    own, other = wanted.select(name).distinct(), live.select(F.col(name).alias("name_")).distinct()
    joined = own.join(other, F.col(name) == F.col("name_"), "full").where(F.col(name).isNull() | F.col("name_").isNull())
    return joined.select(F.when(F.col("name_").isNull(), "added").otherwise("removed").alias("side"), F.coalesce(name, "name_").alias(name))

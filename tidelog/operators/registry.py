"""Schema registry: the latest schema of each table, drift of events against it, changes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import qualified


def latest(versions: DataFrame) -> DataFrame:
    """(table, fingerprint) by the last version (seq) of each table."""
    return versions.groupBy("table").agg(F.max_by("fingerprint", "seq").alias("fingerprint"))


def changes(versions: DataFrame) -> DataFrame:
    """Versions whose fingerprint differs from the one before them; the first of a table is no change."""
    before = F.lag("fingerprint").over(Window.partitionBy("table").orderBy("seq"))
    return versions.withColumn("previous", before).where(F.col("previous") != F.col("fingerprint"))


def drift(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Events with ``known`` (their table is registered) and ``valid`` (under the fingerprint that they carry)."""
    own = registry.select(F.col("table").alias("table_"), F.col("fingerprint").alias("current_"))
    joined = events.join(own, qualified() == F.col("table_"), "left")
    valid = F.coalesce(F.col("schema_fingerprint") == F.col("current_"), F.lit(False))
    return joined.withColumn("known", F.col("table_").isNotNull()).withColumn("valid", valid).drop("table_", "current_")


def sorted_columns(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("schema", "table", "ordinal_position")

"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

A round is two aggregations and joins on the edges; each is written to the shared folder, so no plan grows and a lost
executor costs one round. Neither edges nor nodes come to the driver, only a count and a checksum for each round.
A hub's neighbours are never gathered: its minimum is pre-aggregated and joined back, and Spark splits a skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import drop_path, stored, work_dir


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and its neighbours v in ``edges``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, edges["u"] == least["k"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_min(down)
    pairs = found.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
    return pairs.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node of its component.

    Loops and repeated edges do no harm; rows with a null end are no edges; without edges the result is empty.
    """
    spark = edges.sparkSession
    folder = work_dir(spark, "components")
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), f"{folder}/0")
    was, k = _state(now), 0
    while was[0]:
        k += 1
        now = stored(_small_star(_large_star(now)), f"{folder}/{k}")
        if k > 1:
            drop_path(spark, f"{folder}/{k - 1}")
        if (state := _state(now)) == was:
            break
        was = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())

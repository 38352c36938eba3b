"""Structured Streaming: change files into the log, offsets as state, changes that wait for their schema."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from tidelog.operators.log import BUCKET_SPAN, KEY, append, newest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files of events; files for each trigger bound a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def to_log(events: DataFrame, path: str, checkpoint: str, tenant: str = "default", span: int = BUCKET_SPAN, timeout: float | None = None) -> None:
    """Write all that is there into the log, once: a batch that runs again replaces its own folder.

    Each batch has a folder of its own, so the log is read as ``batches(spark, path)``. A backlog of any size is worked
    off; ``timeout`` (seconds) ends the stream with an error.
    """

    def write(batch: DataFrame, number: int) -> None:
        append(batch, f"{path}/batch={number}", tenant, span=span, mode="overwrite", ingest=number, deal=False)

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end in {timeout} s")
    if query.exception():
        raise query.exception()


def batches(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, span: int = BUCKET_SPAN, last_wins: bool = False) -> DataFrame:
    """The log of all batches, or its events in [low, high]; the folders of other spans are not read."""
    log = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    if low is not None:
        log = log.where((F.col("lsn") >= low) & (F.col("lsn_bucket") >= low // span))
    if high is not None:
        log = log.where((F.col("lsn") <= high) & (F.col("lsn_bucket") <= high // span))
    log = log.drop("batch", "lsn_bucket")
    return newest(log, ("tenant", *KEY)) if last_wins else log


def committed_offsets(commits: DataFrame) -> DataFrame:
    """A stream of (consumer, seq, lsn) to (consumer, committed, accepted, refused), with the position as state."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        accepted = refused = 0
        for lsn in pd.concat(list(rows)).sort_values("seq")["lsn"]:
            if now is not None and lsn < now:
                refused += 1
            else:
                now, accepted = int(lsn), accepted + 1
        state.update((now,))
        yield pd.DataFrame({"consumer": [key[0]], "committed": [now], "accepted": [accepted], "refused": [refused]})

    return commits.groupBy("consumer").applyInPandasWithState(run, "consumer string, committed long, accepted long, refused long", "committed long", "update", GroupStateTimeout.NoTimeout)


def gated_by_schema(events: DataFrame, schemas: DataFrame, wait: str = "5 seconds") -> DataFrame:
    """Events that wait until their fingerprint is registered, at most ``wait`` (event time ``at``), then marked late.

    Both streams have ``at``; an outer stream-stream join lets an event without a schema go with ``schema_known`` false.
    """
    left = events.withWatermark("at", wait)
    right = schemas.select(F.col("fingerprint").alias("known_"), F.col("at").alias("known_at_")).withWatermark("known_at_", wait)
    near = (F.col("schema_fingerprint") == F.col("known_")) & (F.col("known_at_") <= F.col("at") + F.expr(f"interval {wait}")) & (F.col("known_at_") >= F.col("at") - F.expr("interval 1 day"))
    return left.join(right, near, "left_outer").withColumn("schema_known", F.col("known_").isNotNull()).drop("known_", "known_at_")


def idempotent(events: DataFrame, key: list[str], delay: str) -> DataFrame:
    """Events without repeats of a key inside the watermark's delay."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events by operation in event-time windows (sliding with ``slide``); late ones beyond the delay are dropped on a stream."""
    window = F.window("at", size, slide) if slide else F.window("at", size)
    counts = events.withWatermark("at", delay).groupBy(window.alias("w"), "op").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "op", "n")


def session_counts(events: DataFrame, by: list[str], gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events that follow each other by less than the gap, with their number."""
    counts = events.withWatermark("at", delay).groupBy(*by, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

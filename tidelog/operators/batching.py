"""Micro-batches: by count, by bytes, and what a batch is known by."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import LSN_MAX


def count_batches(events: DataFrame, size: int, by: list[str], order: str = "lsn") -> DataFrame:
    """Events with ``batch``: 0 for the first ``size`` of a group, and so on."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return events.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def batch_stats(batches: DataFrame, by: list[str], size: str = "bytes") -> DataFrame:
    return batches.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.sum(size).alias("total_bytes"))


#: Stats of a batch without events (fixed values).
EMPTY_BATCH = {"events": 0, "min_lsn": LSN_MAX, "max_lsn": 0, "total_bytes": 0}


def byte_batches(events: DataFrame, most: int, by: list[str], order: str = "lsn", size: str = "bytes") -> DataFrame:
    """Events with ``batch``: a batch is flushed with the event that brings it to ``most`` bytes, the next starts at 0.

    The sum starts anew at every flush, which no window frame can do, so it is a sequential fold inside a group. It
    streams over a group's sorted rows in Arrow batches and keeps two numbers, so a group may be of any size. An unknown
    size counts as 0; a column ``batch`` is replaced.
    """
    events = events.drop("batch")
    keys = [F.col(c) for c in by]
    sorted_ = events.repartition(*keys).sortWithinPartitions(*by, order)
    names = events.columns

    def run(batches):
        import pyarrow as pa

        now, total, number = None, 0, 0
        for batch in batches:
            out = []
            columns = [batch.column(names.index(c)).to_pylist() for c in by]
            for key, own in zip(zip(*columns, strict=True), batch.column(names.index(size)).to_pylist(), strict=True):
                if key != now:
                    now, total, number = key, 0, 0
                out.append(number)
                total += own or 0
                if total >= most:
                    total, number = 0, number + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*names, "batch"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return sorted_.mapInArrow(run, f"{kind}, batch long")

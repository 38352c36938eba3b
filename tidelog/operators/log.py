"""The sorted Parquet log: append, range scans, replay, last-write-wins, retention.

A log is partitioned by tenant and by ``lsn_bucket`` (a fixed span of LSNs) and sorted by LSN inside its files, so a
range prunes folders, then row groups. A key that is written again replaces the row before it: every row has the
``ingest`` number of its append and its place in it, no part of the key, so the last that was written is the newest of
equal keys. Reads keep that one where it is asked for; a replayed micro-batch overwrites its own folder.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.batching import byte_batches
from tidelog.schema import qualified

BUCKET_SPAN = 1 << 20
#: The key of a stored event; ``COMPAT_KEY`` lets rows of one LSN and transaction replace each other.
KEY = ("lsn", "xid", "table", "seq")
COMPAT_KEY = ("lsn", "xid")
#: What is newer comes later in this order, as far as the columns are there.
ORDER = ("lsn", "xid", "seq", "ingest", "ingest_row")


def bucket(lsn: Column, span: int = BUCKET_SPAN) -> Column:
    return F.floor(lsn / span).cast("long")


def append(events: DataFrame, path: str, tenant: str = "default", codec: str = "zstd", span: int = BUCKET_SPAN, mode: str = "append", ingest: int | None = None, deal: bool = True) -> None:
    """Append events of one tenant; rows of a bucket stand in one place, sorted by their key.

    ``ingest`` numbers the append and has to rise from one to the next (a batch number; by default the time in microseconds).
    Without ``deal`` rows stay in the partitions that they are in, each sorted: right for micro-batches, whose few files
    cost less than a range exchange, and for rows that come in order.
    """
    number = time.time_ns() // 1000 if ingest is None else ingest
    rows = events.withColumns({"ingest": F.lit(number).cast("long"), "ingest_row": F.monotonically_increasing_id()})
    rows = rows.withColumn("tenant", F.lit(tenant)).withColumn("lsn_bucket", bucket(F.col("lsn"), span))
    dealt = (rows.repartitionByRange("lsn_bucket", "lsn") if deal else rows).sortWithinPartitions("lsn_bucket", "lsn", "xid")
    dealt.write.mode(mode).option("compression", codec).partitionBy("tenant", "lsn_bucket").parquet(path)


def read(spark: SparkSession, path: str, tenant: str | None = None, low: int | None = None, high: int | None = None, span: int = BUCKET_SPAN, last_wins: bool = False) -> DataFrame:
    """A tenant's events in [low, high]; both the folders and the row groups are pruned.

    With ``last_wins`` of rows with an equal key only the one that was written last.
    """
    log = spark.read.parquet(path)
    if tenant is not None:
        log = log.where(F.col("tenant") == tenant)
    if low is not None:
        log = log.where((F.col("lsn") >= low) & (F.col("lsn_bucket") >= low // span))
    if high is not None:
        log = log.where((F.col("lsn") <= high) & (F.col("lsn_bucket") <= high // span))
    return newest(log.drop("lsn_bucket"), ("tenant", *KEY)) if last_wins else log.drop("lsn_bucket")


def read_from(log: DataFrame, start: int, limit: int) -> DataFrame:
    """Up to ``limit`` events in log order from ``start`` on."""
    return log.where(F.col("lsn") >= start).orderBy("lsn", "xid").limit(limit)


def replay_range(committed: Column, head: Column) -> Column:
    """(start, end, estimate) of what a consumer has not seen; null if it has seen all."""
    start = committed + 1
    return F.when(committed < head, F.struct(start.alias("start"), head.alias("end"), F.greatest(head - start, F.lit(0)).alias("estimate")))


def replay(log: DataFrame, committed: int, head: int) -> DataFrame:
    return log.where(F.col("lsn").between(committed + 1, head)) if committed < head else log.where(F.lit(False))


def newest(events: DataFrame, key: tuple[str, ...] | list = KEY, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The newest row of each key, combined where the rows are before they are shuffled."""
    by = F.struct(*[F.col(c) for c in order if c in events.columns])
    keys = [c for c in key if not isinstance(c, str) or c in events.columns]
    whole = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    return events.groupBy(*[(F.col(c) if isinstance(c, str) else c).alias(f"key_{k}") for k, c in enumerate(keys)]).agg(F.max_by(whole, by).alias("row_")).select("row_.*")


def state(events: DataFrame, key: list, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows as they now are: the last change of each key, without those that were deleted."""
    return newest(events, key, order).where(F.col("op").isin("insert", "update"))


def carried(events: DataFrame, by: list[str], value: Column, name: str, order: str = "lsn") -> DataFrame:
    """Events with ``name``: the last value that is not null up to each event of its group, as of its place."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.last(value, True).over(w))


def truncated(events: DataFrame) -> DataFrame:
    """Events that no later truncate of their table undid."""
    cut = events.where("op = 'truncate'").groupBy(qualified().alias("name_")).agg(F.max("lsn").alias("cut_"))
    joined = events.join(cut, qualified() == F.col("name_"), "left")
    return joined.where((F.col("op") != "truncate") & (F.col("cut_").isNull() | (F.col("lsn") > F.col("cut_")))).drop("name_", "cut_")


def survivors(events: DataFrame, watermark: int | Column) -> DataFrame:
    """What garbage collection leaves: events at the watermark and above."""
    return events.where(F.col("lsn") >= watermark)


def collect_garbage(spark: SparkSession, path: str, tenant: str, watermark: int, span: int = BUCKET_SPAN) -> int:
    """Drop a tenant's buckets that lie below the watermark; the bucket at the boundary is filtered when read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tenant={tenant}")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = 0
    if fs.exists(hadoop):
        for status in fs.listStatus(hadoop):
            name = status.getPath().getName()
            if name.startswith("lsn_bucket=") and (int(name.removeprefix("lsn_bucket=")) + 1) * span <= watermark:
                dropped += bool(fs.delete(status.getPath(), True))
    return dropped


def ttl_survivors(events: DataFrame, now_us: int, ttl_secs: int) -> DataFrame:
    """Events that are not older than the time to live; 0 keeps all, an unknown time keeps an event."""
    if ttl_secs <= 0:
        return events
    return events.where((F.col("commit_timestamp_us") == 0) | (F.col("commit_timestamp_us") >= now_us - ttl_secs * 1_000_000))


def rate_limited(events: DataFrame, per_second: int) -> DataFrame:
    """The first ``per_second`` events of each tenant and second; 0 is no limit."""
    if per_second <= 0:
        return events
    second = F.floor(F.col("commit_timestamp_us") / 1_000_000)
    return events.withColumn("n_", F.row_number().over(Window.partitionBy("tenant", second).orderBy("lsn", "xid"))).where(F.col("n_") <= per_second).drop("n_")


def wal_frames(events: DataFrame, segment_bytes: int, by: list[str]) -> DataFrame:
    """(lsn, payload) of each writer with ``frame`` (u32 length, u64 lsn, payload; big-endian) and its ``segment``.

    A segment is closed once it holds ``segment_bytes``; ``control.WalWriter`` writes the same bytes.
    """
    number = lambda x, n: F.unhex(F.lpad(F.hex(x), 2 * n, "0"))
    size = F.octet_length("payload")
    framed = events.withColumn("frame", F.concat(number(size + 8, 4), number(F.col("lsn"), 8), F.col("payload").cast("binary"))).withColumn("bytes", size + 12)
    return byte_batches(framed, segment_bytes, by).withColumnRenamed("batch", "segment")


def old_segments(segments: DataFrame, current: int) -> DataFrame:
    """Write-ahead segments that may go: all but the current one and the two before it."""
    return segments.where(F.col("segment") + 2 < current)

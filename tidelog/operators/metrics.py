"""Counters, gauges, histograms and their text form; index percentiles of a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the flush-latency buckets in seconds (fixed values).
FLUSH_BOUNDS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1)
COUNTERS = ("events_ingested", "events_filtered", "events_flushed", "storage_writes", "storage_bytes", "events_delivered", "errors")


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def histogram(samples: DataFrame, value: str, bounds: tuple[float, ...] = FLUSH_BOUNDS) -> DataFrame:
    """(le, n) cumulative, the last bucket without a bound (null)."""
    below = [F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)]
    sums = samples.agg(*below, F.count(value).alias("every"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("every").alias("n")))
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.le", "r.n")


def index_percentiles(samples: DataFrame, by: str, value: str, points: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """count, min, max, mean (whole) and the values at index count * p / 100 of the sorted samples; no interpolation.

    Equal values are counted first and running counts cut, so a group's samples are never gathered.
    """
    from pyspark.sql import Window

    counts = samples.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    total = samples.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.floor(F.sum(value) / F.count(F.lit(1))).cast("long").alias("mean"))
    joined = upto.join(total, by)
    index = lambda p: F.least(F.floor(F.col("count") * p / 100), F.col("count") - 1)
    at = [F.min(F.when(F.col("upto") > index(p), F.col(value))).alias(f"p{p}") for p in points]
    return joined.groupBy(by, "count", "min", "max", "mean").agg(*at)


def exposition(rows: DataFrame, name: str, labels: list[str], value: str = "n", prefix: str = "tidelog_") -> DataFrame:
    """A line of the text format for each row of labels and a whole value."""
    escaped = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    inner = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in sorted(labels)])
    return rows.select(F.concat(F.lit(f"{prefix}{name}{{"), inner, F.lit("} "), F.col(value).cast("long").cast("string")).alias("line"))


def consumer_gauges(offsets: DataFrame, head: DataFrame) -> DataFrame:
    """(name, value) of consumers (consumer, committed) and of a log's head (one row)."""
    sums = offsets.agg(F.count(F.lit(1)).alias("active_consumers"), F.min("committed").alias("least")).crossJoin(F.broadcast(head))  # one row each
    lag = F.greatest(F.col("head") - F.coalesce("least", F.col("head")), F.lit(0))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("long").alias("value")) for n, v in (("active_consumers", F.col("active_consumers")), ("head", F.col("head")), ("lag", lag))])
    return sums.select(F.explode(rows).alias("g")).select("g.*")


def prometheus(values: dict[str, float], labelled: dict[str, list[tuple[dict, float]]] | None = None, prefix: str = "tidelog_") -> str:
    """The text exposition format of plain and labelled values."""
    lines = [f"{prefix}{name} {value:g}" for name, value in sorted(values.items())]
    for name, rows in sorted((labelled or {}).items()):
        for labels, value in rows:
            inner = ",".join('{}="{}"'.format(k, str(v).replace("\\", "\\\\").replace('"', '\\"')) for k, v in sorted(labels.items()))
            lines.append(f"{prefix}{name}{{{inner}}} {value:g}")
    return "\n".join(lines) + "\n"


def gauges(progress: dict, offsets: dict[str, int] | None = None, head: int = 0, budget: int = 0, used: int = 0) -> dict[str, float]:
    """Gauges of a driver: from a StreamingQueryProgress as a dict, consumers' offsets and the memory in use."""
    found = {"input_rows_per_second": progress.get("inputRowsPerSecond") or 0.0, "processed_rows_per_second": progress.get("processedRowsPerSecond") or 0.0, "batch": progress.get("batchId", -1)}
    if offsets is not None:
        found |= {"active_consumers": len(offsets), "lag": max(0, head - min(offsets.values(), default=head))}
    return found | {"memory_used": used, "memory_budget": budget}

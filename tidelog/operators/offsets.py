"""Consumer offsets: commits, regressions, resume points, watermarks, lag, garbage-collection runs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.errors import OffsetRegression
from tidelog.functions import lsn as lsn_functions
from tidelog.schema import LSN_MAX


def commits(attempts: DataFrame) -> DataFrame:
    """(consumer, seq, lsn) with ``accepted``: a commit below the highest before it is refused and changes nothing.

    The highest commit so far is the highest accepted one, as a refused commit is below it.
    """
    before = Window.partitionBy("consumer").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    highest = F.max("lsn").over(before)
    return attempts.withColumn("current", highest).withColumn("accepted", F.coalesce(F.col("lsn") >= highest, F.lit(True)))


def committed(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("consumer").agg(F.max("lsn").alias("committed"))


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each consumer, which may be lower than one before it."""
    return updates.groupBy("consumer").agg(F.max_by("lsn", "seq").alias("committed"))


def resume(committed_: Column) -> Column:
    """One past the committed position; 0 for a consumer that never committed."""
    return F.coalesce(lsn_functions.add(committed_, 1), F.lit(0))


def watermark(offsets: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """The lowest committed position, 0 without consumers.

    With ``registered`` consumers that never committed hold the watermark at 0.
    """
    least = F.min("committed")
    if registered is not None:
        offsets = registered.select("consumer").join(offsets, "consumer", "left").withColumn("committed", F.coalesce("committed", F.lit(0)))
    return offsets.agg(F.when(least == LSN_MAX, 0).otherwise(F.coalesce(least, F.lit(0))).alias("watermark"))


def watermarks(offsets: DataFrame, registered: DataFrame, by: str) -> DataFrame:
    """The same for each group of consumers: (by, watermark); both tables have the columns consumer and ``by``."""
    done = offsets.select(F.col("consumer").alias("consumer_"), F.col(by).alias("by_"), "committed")
    joined = registered.join(done, (F.col("consumer") == F.col("consumer_")) & F.col(by).eqNullSafe(F.col("by_")), "left")
    return joined.groupBy(by).agg(F.min(F.coalesce("committed", F.lit(0))).alias("watermark"))


def consumers(offsets: DataFrame) -> DataFrame:
    return offsets.select("consumer").distinct()


def registered(actions: DataFrame) -> DataFrame:
    """(consumer, committed) of consumers that are registered after (consumer, seq, action, lsn).

    ``register`` and ``commit`` make a consumer known, ``unregister`` forgets it with its position; a consumer that has
    not committed since then stands at null.
    """
    gone = actions.where("action = 'unregister'").groupBy(F.col("consumer").alias("consumer_")).agg(F.max("seq").alias("gone"))
    since = actions.join(gone, F.col("consumer") == F.col("consumer_"), "left").where("gone is null or seq > gone")
    return since.groupBy("consumer").agg(F.max(F.when(F.col("action") == "commit", F.col("lsn"))).alias("committed"))


def gc_runs(history: DataFrame) -> DataFrame:
    """(seq, watermark) with ``ran``: a run happens only where the watermark passes all before it.

    One history of watermarks is one ordered sequence; ``scheduler`` tells several apart.
    """
    own = history if "scheduler" in history.columns else history.withColumn("scheduler", F.lit("default"))
    before = Window.partitionBy("scheduler").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("last_gc", F.coalesce(F.max("watermark").over(before), F.lit(0))).withColumn("ran", F.col("watermark") > F.col("last_gc"))


def status(offsets: DataFrame, head: int | Column, connected: list[str] | None = None) -> DataFrame:
    head = F.lit(head) if isinstance(head, int) else head
    found = offsets.select("consumer", "committed", head.alias("head"), F.greatest(head - F.col("committed"), F.lit(0)).alias("lag"))
    return found if connected is None else found.withColumn("connected", F.col("consumer").isin(*connected) if connected else F.lit(False))


def every_nth(events: DataFrame, n: int) -> DataFrame:
    """The positions that a consumer commits that commits after every n events."""
    numbered = events.withColumn("n_", F.row_number().over(Window.partitionBy("consumer").orderBy("lsn")))
    return numbered.where(F.col("n_") % n == 0).drop("n_")


# ---- lag and slots -------------------------------------------------------------------------------------------


def lag_status(lag: Column, cap: int) -> Column:
    return F.when(lag > cap, "critical").when(lag > cap * 0.85, "warning").otherwise("ok")


def pause_fold(samples: DataFrame, cap: int) -> DataFrame:
    """(slot, seq, lag) with ``paused``: from above the cap until below half of it.

    The last sample outside the band between the two decides, so a window does what a state machine would.
    """
    decisive = F.when(F.col("lag") > cap, True).when(F.col("lag") < cap // 2, False)
    w = Window.partitionBy("slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("paused", F.coalesce(F.last(decisive, True).over(w), F.lit(False)))


def slot_report(consumer_watermark: Column, persisted: Column, lag_cap: int) -> Column:
    """The position to confirm: the consumers', but no further behind than the cap allows."""
    return F.least(consumer_watermark, persisted - lag_cap)


def slot_state(lag: Column, disconnected_secs: Column, warn: int = 10 << 30, resync: int = 50 << 30, longest: int = 3600) -> Column:
    return F.when((lag > resync) | (disconnected_secs > longest), "force_resync").when(lag > warn, "warning").otherwise("ok")


def acknowledged(acks: DataFrame) -> DataFrame:
    """(stream, seq, received, confirmed) as reported: positions only advance; written = received, flushed = applied = confirmed."""
    w = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return acks.select("stream", "seq", F.max("received").over(w).alias("write"), F.max("confirmed").over(w).alias("flush"), F.max("confirmed").over(w).alias("apply"))


# ---- stores --------------------------------------------------------------------------------------------------


class FileOffsetStore:
    """Offsets of a few consumers as JSON below a folder; every change is a new file with the next number.

    The highest number counts. A file gets its name by a rename once it is whole, so a crash at any point leaves the
    one before it. A number is claimed by creating a file that must not be there: of two writers one has to take the
    next number, and a writer that finds itself overtaken applies its change again, so no commit is lost.
    """

    KEPT = 5

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark._jvm, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _numbers(self, end: str) -> list[int]:
        names = [status.getPath().getName() for status in self._fs.listStatus(self._path(""))]
        return sorted(int(n.removesuffix(end)) for n in names if n.endswith(end))

    def _last(self) -> tuple[int, dict[str, int]]:
        while found := self._numbers(".json"):
            try:
                stream = self._fs.open(self._path(f"{found[-1]:012d}.json"))
            except Exception:  # a writer has cleared it since: there is a later one
                if found[-1] in self._numbers(".json"):
                    raise
                continue
            try:
                return found[-1], json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return 0, {}

    def load(self) -> dict[str, int]:
        return self._last()[1]

    def commit(self, consumer: str, lsn: int) -> None:
        """Raises OffsetRegression below the committed position; an equal one is fine."""

        def change(offsets: dict[str, int]) -> dict[str, int]:
            if lsn < offsets.get(consumer, 0):
                raise OffsetRegression(consumer, offsets[consumer], lsn)
            return offsets | {consumer: lsn}

        self._change(change, lambda offsets: offsets.get(consumer, -1) >= lsn)

    def register(self, consumer: str) -> None:
        """A consumer that has committed nothing yet stands at -1 and resumes at 0; one that is there stays as it is."""
        self._change(lambda offsets: {consumer: -1} | offsets, lambda offsets: consumer in offsets)

    def unregister(self, consumer: str) -> None:
        self._change(lambda offsets: {c: lsn for c, lsn in offsets.items() if c != consumer}, lambda offsets: consumer not in offsets)

    def resume(self, consumer: str) -> int:
        offsets = self.load()
        return min(offsets[consumer] + 1, LSN_MAX) if consumer in offsets else 0

    def _change(self, change: Callable[[dict[str, int]], dict[str, int]], done: Callable[[dict[str, int]], bool]) -> None:
        while True:
            number, offsets = self._last()
            new = change(offsets)
            number = max([number, *self._numbers(".claim")]) + 1
            if not self._claim(number):
                continue
            own = f"{number:012d}.{uuid.uuid4().hex}.new"
            out = self._fs.create(self._path(own), False)
            out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
            out.close()
            self._fs.rename(self._path(own), self._path(f"{number:012d}.json"))
            last, offsets = self._last()
            if last == number or done(offsets):
                break
        for end in (".json", ".claim"):
            for old in self._numbers(end):
                if old <= number - self.KEPT:
                    self._fs.delete(self._path(f"{old:012d}{end}"), False)

    def _claim(self, number: int) -> bool:
        path = self._path(f"{number:012d}.claim")
        try:
            self._fs.create(path, False).close()
        except Exception:  # another writer has it
            if not self._fs.exists(path):
                raise
            return False
        return True

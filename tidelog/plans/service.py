"""What a consumer and an administrator ask of a log: subscribe, commit, status, health; reload, diff, keys, garbage.

Plain Python functions over a log's folder and an offset store, in place of remote calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import ConfigInvalid
from tidelog.operators import log
from tidelog.operators.control import Lifecycle
from tidelog.operators.offsets import FileOffsetStore
from tidelog.plans import publication
from tidelog.plans.rules import RuleSet
from tidelog.plans.subscription import Subscription, subscribe


class Service:
    """One tenant's log below ``path`` and the offsets of its consumers."""

    def __init__(self, spark: SparkSession, path: str, offsets: str, tenant: str = "default", span: int = log.BUCKET_SPAN, rules: RuleSet | None = None):
        self.spark, self.path, self.tenant, self.span = spark, path, tenant, span
        self.offsets, self.lifecycle, self.rules = FileOffsetStore(spark, offsets), Lifecycle(), rules or RuleSet()
        self.keys: dict[str, Column] = {}
        self.lifecycle.to("running")

    # for consumers

    def events(self, low: int | None = None) -> DataFrame:
        return self.rules.apply(log.read(self.spark, self.path, self.tenant, low=low, span=self.span, last_wins=True))

    def subscribe(self, wanted: Subscription, predicate: Callable[[str], Column] | None = None) -> DataFrame:
        """A consumer's events from its resume position on, or from the committed one if that is further."""
        start = max(wanted.resume, self.offsets.resume(wanted.consumer))
        return subscribe(self.events(start), replace(wanted, resume=start), predicate, self.keys.get(wanted.consumer))

    def commit_offset(self, consumer: str, lsn: int) -> None:
        """Raises OffsetRegression below what is committed, and ConfigInvalid beyond the head."""
        head = self.head()
        if lsn > head:
            raise ConfigInvalid(f"{lsn} is beyond the head {head}")
        self.offsets.commit(consumer, lsn)

    def head(self) -> int:
        return log.read(self.spark, self.path, self.tenant, span=self.span).agg(F.max("lsn")).first()[0] or 0

    def status(self, consumer: str) -> dict:
        """committed (null: never), head, lag and whether the consumer is known."""
        known, head = self.offsets.load(), self.head()
        committed = known.get(consumer, -1)
        return {"consumer": consumer, "registered": consumer in known, "committed": None if committed < 0 else committed, "head": head, "lag": head - max(committed, 0)}

    def health(self) -> str:
        return "serving" if self.lifecycle.ready else "not serving"

    def watch(self, every: float = 1.0, wait: Callable[[float], None] = time.sleep) -> Iterator[str]:
        """The health now, and again whenever it changes, until the service has stopped."""
        last = None
        while True:
            now = self.health()
            if now != last:
                yield now
                last = now
            if not self.lifecycle.live:
                return
            wait(every)

    # for administrators

    def register(self, consumer: str, key: Column | None = None) -> None:
        """Make a consumer known, so that it holds garbage collection at 0, with the key that opens its columns."""
        self.offsets.register(consumer)
        if key is not None:
            self.keys[consumer] = key

    def unregister(self, consumer: str) -> None:
        self.offsets.unregister(consumer)
        self.keys.pop(consumer, None)

    def consumers(self) -> list[dict]:
        head = self.head()
        return [{"consumer": c, "committed": None if lsn < 0 else lsn, "lag": head - max(lsn, 0)} for c, lsn in sorted(self.offsets.load().items())]

    def reload(self, rules: dict[str, str]) -> list[str]:
        """Take other ingestion rules; the tables whose rule is new, changed or gone."""
        old, self.rules = self.rules, RuleSet.from_config(rules)
        return sorted(t for t in old.rules.keys() | self.rules.rules.keys() if old.rules.get(t) != self.rules.rules.get(t))

    def publication_diff(self, wanted: list[publication.PublishedTable], live: list[publication.PublishedTable]) -> dict[str, str]:
        rows = publication.diff(publication.as_frame(self.spark, wanted), publication.as_frame(self.spark, live))
        return {r["table"]: r["action"] for r in rows.collect()}  # a row for each published table

    def watermark(self) -> int:
        """What every registered consumer has committed; 0 without consumers or where one has committed nothing."""
        return max(0, min(self.offsets.load().values(), default=0))

    def collect_garbage(self) -> int:
        """Drop the folders below the watermark; how many went."""
        return log.collect_garbage(self.spark, self.path, self.tenant, self.watermark(), self.span)

    def drain(self) -> None:
        self.lifecycle.to("draining")

    def stop(self) -> None:
        self.lifecycle.to("stopped")

"""Subscriptions: tables, operations, a predicate, columns and a position, as one plan over the log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import FilterConflict
from tidelog.operators import crypto
from tidelog.operators.log import read_from
from tidelog.plans.rules import ReadFilter
from tidelog.schema import is_table


def project(data: Column, names: list[str]) -> Column:
    """A row cut to some columns, in its own order; a name that is missing is no error."""
    return F.filter(data, lambda c: c["name"].isin(*names))


def projected(events: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Rows of the given tables cut to their columns; other tables stay whole. Predicates come before this."""
    for image in ("after", "before"):
        cut = F.col(image)
        for table, names in columns.items():
            cut = F.when(is_table(table), project(F.col(image), names)).otherwise(cut)
        events = events.withColumn(image, cut)
    return events


def missing_columns(events: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """(table, column, events): listed columns that events of the table lack."""
    found = None
    for table, names in columns.items():
        rows = events.where(is_table(table) & F.col("after").isNotNull()).select(F.lit(table).alias("table"), F.explode(F.array_except(F.array(*map(F.lit, names)), F.transform("after", lambda c: c["name"]))).alias("column"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("table", "column").agg(F.count(F.lit(1)).alias("events"))


@dataclass(frozen=True)
class Subscription:
    consumer: str
    tables: tuple[str, ...] | None = None
    ops: tuple[str, ...] = ()
    predicate: str | None = None
    columns: dict[str, list[str]] | None = None
    encrypted: tuple[str, ...] = ()
    resume: int = 0
    credits: int | None = None


def check(subscription: Subscription, above: dict[str, list[str]] | None) -> None:
    """Raise FilterConflict for columns that the stream above already left out."""
    for table, names in (subscription.columns or {}).items():
        gone = set(names) - set((above or {}).get(table, names))
        if gone:
            raise FilterConflict(f"{table}: {', '.join(sorted(gone))}")


def subscribe(log: DataFrame, subscription: Subscription, predicate: Callable[[str], Column] | None = None, key: Column | None = None, above: dict[str, list[str]] | None = None) -> DataFrame:
    """Events from the resume position on: tables, then operations, predicate, columns, decryption, credits."""
    check(subscription, above)
    events = ReadFilter(subscription.tables, low=subscription.resume).apply(log)
    if subscription.ops:
        events = events.where(F.col("op").isin(*subscription.ops))
    if subscription.predicate:
        events = events.where(predicate(subscription.predicate))
    if subscription.columns:
        events = projected(events, subscription.columns)
    if subscription.encrypted and key is not None:
        events = crypto.decrypt(events, list(subscription.encrypted), key)
    return events if subscription.credits is None else read_from(events, subscription.resume, subscription.credits)


def inspect(log: DataFrame, predicate: Column, last: int = 10_000) -> DataFrame:
    """(events, passed, pass_rate) of a predicate over the newest events."""
    recent = log.orderBy(F.desc("lsn")).limit(last)
    passed = F.count_if(F.coalesce(predicate, F.lit(False)))
    return recent.agg(F.count(F.lit(1)).alias("events"), passed.alias("passed"), (passed / F.count(F.lit(1))).alias("pass_rate"))


def inspect_report(pass_rate: float, description: str) -> dict:
    warnings = (["nothing passes"] if pass_rate == 0 else []) + (["everything passes"] if pass_rate == 1 else [])
    return {"description": description, "pass_rate": pass_rate, "warnings": warnings}


def mux(streams: dict[str, DataFrame]) -> DataFrame:
    """Several streams as one, each row with its stream's name."""
    found = None
    for name, stream in streams.items():
        own = stream.withColumn("stream", F.lit(name))
        found = own if found is None else found.unionByName(own)
    return found

"""Delivery to consumers and webhooks: payloads, retries, circuit breakers, dead letters."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.hashing import hmac_sha256, signature
from tidelog.schema import qualified

CONTENT_HEADER = {"Content-Type": "application/json"}
EVENTS_HEADER, SIGNATURE_HEADER, EVENT_ID_HEADER = "X-Tidelog-Events", "X-Tidelog-Signature", "X-Event-ID"


def header_json(table: Column | None = None) -> Column:
    """One event's header as JSON text; names are not escaped."""
    name = qualified() if table is None else table
    return F.concat(F.lit('{"lsn":'), F.col("lsn"), F.lit(',"xid":'), F.col("xid"), F.lit(',"op":"'), F.col("op"), F.lit('","table":"'), name, F.lit('","ts":'), F.col("commit_timestamp_us"), F.lit("}"))


def full_json() -> Column:
    """One event with its rows as JSON text, escaped."""
    columns = lambda c: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return F.to_json(F.struct("lsn", "xid", "op", qualified().alias("table"), F.col("commit_timestamp_us").alias("ts"), columns("after").alias("after"), columns("before").alias("before")))


def payloads(batches: DataFrame, by: list[str], item: Column | None = None) -> DataFrame:
    """One JSON array for each batch, in log order. A batch has a bounded number of events."""
    own = batches.select(*by, F.struct("lsn", "xid", (header_json() if item is None else item).alias("json")).alias("e"))
    rows = own.groupBy(*by).agg(F.sort_array(F.collect_list("e")).alias("all"))
    body = F.concat(F.lit("["), F.array_join(F.transform("all", lambda e: e["json"]), ","), F.lit("]"))
    return rows.select(*by, F.size("all").cast("long").alias("events"), body.alias("payload"))


def request_headers(payload: str, events: int, secret: str | None = None, event_id: str | None = None, compat: bool = False) -> dict[str, str]:
    headers = CONTENT_HEADER | {EVENTS_HEADER: str(events)}
    if secret:
        headers[SIGNATURE_HEADER] = signature(secret, payload.encode(), compat)
    return headers | ({EVENT_ID_HEADER: event_id} if event_id else {})


def signed(payloads_: DataFrame, secret: str) -> DataFrame:
    """Payloads with the values of the events header and the signature header of their requests."""
    return payloads_.withColumns({"events_header": F.col("events").cast("string"), "signature": F.concat(F.lit("sha256="), hmac_sha256(secret, F.col("payload")))})


def sent_stats(events: DataFrame) -> DataFrame:
    """(consumer) with the last LSN sent and how many events were."""
    return events.groupBy("consumer").agg(F.max("lsn").alias("last_sent_lsn"), F.count(F.lit(1)).alias("events_sent"))


def backoff_ms(attempt: Column, initial: int, longest: int = 60_000) -> Column:
    """Doubling from ``initial`` up to ``longest``."""
    return F.least(F.lit(float(initial)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(62))), F.lit(float(longest))).cast("long")


def may_retry(attempt: Column, most: int) -> Column:
    """Whether another attempt follows attempt number ``attempt`` (from 0); ``most`` counts the first."""
    return attempt + 1 < most


def circuit(outcomes: DataFrame, threshold: int, timeout_us: int) -> DataFrame:
    """(target, seq, at_us, ok) with ``allowed``, ``state`` (after the call) and ``trips`` of each target's breaker.

    Closed until ``threshold`` failures in a row; open until ``timeout_us`` has passed, when the next call is the one
    probe: its success closes the breaker, its failure opens it again. A call that is not allowed has no outcome.
    A sequential state machine for each target, streamed over sorted rows with a state of a few numbers.
    """
    dealt = outcomes.select("target", "seq", "at_us", "ok").repartition("target").sortWithinPartitions("target", "seq")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tidelog.operators.control import CircuitBreaker

        now, breaker, trips = None, None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if breaker is None or r["target"] != now:
                    now, breaker, trips = r["target"], CircuitBreaker(threshold, timeout_us), 0
                allowed = breaker.allow(r["at_us"])
                if allowed:
                    was = breaker.state
                    breaker.report(r["ok"], r["at_us"])
                    trips += was != "open" and breaker.state == "open"
                out.append((allowed, breaker.state, trips))
            extra = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(extra[0], pa.bool_()), pa.array(extra[1], pa.string()), pa.array(extra[2], pa.int64())], ["target", "seq", "at_us", "ok", "allowed", "state", "trips"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(run, f"{kind}, allowed boolean, state string, trips long")


def dead_letters(failures: DataFrame, most: int, order: str = "seq") -> DataFrame:
    """The newest ``most`` failures, each with the number of all."""
    total = failures.agg(F.count(F.lit(1)).alias("total_entries"))
    return failures.orderBy(F.desc(order)).limit(most).crossJoin(F.broadcast(total))  # one row


def deliver(
    payloads_: DataFrame, send: Callable[[str, str, dict], int], most_attempts: int = 5, secret: str | None = None, folder: str | None = None,
    initial_ms: int = 100, longest_ms: int = 60_000, threshold: int = 5, timeout_ms: int = 30_000, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Send (target, batch, events, payload) where the rows are; (target, batch, attempts, error) of each.

    A target's batches go out in order, one after the other. ``send`` (target, payload, headers) returns a status and is
    pickled to the executors; 400 and above, or an exception, is a failure. A failure is tried again after a wait that
    doubles. A target's breaker opens after ``threshold`` failures in a row; while it is open batches are not sent
    (error "circuit open"). What is not delivered comes back with its error, for ``undelivered``.

    Every evaluation of the result sends. With ``folder`` it is evaluated once, written there and read back. A task that
    is repeated sends its batches again: receivers know them by the event id header.
    """
    dealt = payloads_.select(F.col("target").cast("string"), F.col("batch").cast("long"), "events", "payload").repartition("target").sortWithinPartitions("target", "batch")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tidelog.operators.control import CircuitBreaker, RetryPolicy

        retry, now, breaker = RetryPolicy(most_attempts, initial_ms, longest_ms), None, None
        clock = lambda: int(time.monotonic() * 1000)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if breaker is None or r["target"] != now:
                    now, breaker = r["target"], CircuitBreaker(threshold, timeout_ms)
                error, attempts = "circuit open", 0
                while breaker.allow(clock()):
                    try:
                        status = send(r["target"], r["payload"], request_headers(r["payload"], r["events"], secret, f"{r['target']}-{r['batch']}"))
                        error = f"status {status}" if status >= 400 else None
                    except Exception as e:  # noqa: BLE001  whatever a transport raises is a failed delivery
                        error = f"{type(e).__name__}: {e}"
                    attempts += 1
                    breaker.report(error is None, clock())
                    if error is None or not retry.again(attempts - 1):
                        break
                    wait(retry.backoff(attempts - 1) / 1000)
                out.append({"target": r["target"], "batch": r["batch"], "attempts": attempts, "error": error})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("target", pa.string()), ("batch", pa.int64()), ("attempts", pa.int64()), ("error", pa.string())]))

    kind = "target string, batch long, attempts long, error string"
    results = dealt.mapInArrow(run, kind)
    if folder is None:
        return results
    results.write.mode("overwrite").parquet(folder)
    return payloads_.sparkSession.read.schema(kind).parquet(folder)


def undelivered(results: DataFrame, payloads_: DataFrame) -> DataFrame:
    """The dead letters of a delivery: (target, batch, events, payload, attempts, error)."""
    failed = results.where("error is not null").select(F.col("target").alias("target_"), F.col("batch").alias("batch_"), "attempts", "error")
    own = payloads_.select(F.col("target").cast("string").alias("target"), F.col("batch").cast("long").alias("batch"), "events", "payload")
    return own.join(failed, (F.col("target") == F.col("target_")) & (F.col("batch") == F.col("batch_"))).drop("target_", "batch_")


def health(ready: bool, live: bool) -> str:
    return json.dumps({"ready": ready, "live": live}, separators=(",", ":"))

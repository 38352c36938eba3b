"""Further queries: control models over the log, captured frames of every kind, streams, delivery.

Each model of ``operators.control`` runs over the events of each user in order; the SQL says the same with windows or a
recursive query.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import hashing
from tidelog.operators import batching, control, crypto, delivery, log, metrics, offsets
from tidelog.operators.folds import fold
from tidelog.queries import _FOLD, HAS, L, _attempts, _shared, change_log, query, table
from tidelog.schema import qualified, row, table_id, text
from tidelog.sources import ddl, frames, probes, snapshot
from tidelog.streaming import log_stream


def _ordered(spark, sf_dir) -> DataFrame:
    """The log's events by user: target, lsn, op, tbl, us, bytes, n (place among the user's)."""
    e = change_log(spark, sf_dir)
    rows = e.select(F.col("xid").alias("target"), "lsn", "op", F.col("table.table").alias("tbl"), F.col("commit_timestamp_us").alias("us"), F.octet_length("data.props").cast("long").alias("bytes"))
    return batching.count_batches(rows, 1, ["target"]).withColumn("n", F.col("batch") + 1).drop("batch")


_R = "r AS (SELECT user_id AS target, lsn, op, tbl, us, CAST(strlen(props) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY lsn) AS n FROM log)"


def _walk(first: str, each: str, out: str) -> str:
    """A recursive query over each user's events: state columns at the first event, at each one from the one before."""
    return _FOLD + f", {_R}, f AS (SELECT target, lsn, n, {first} FROM r WHERE n = 1 UNION ALL SELECT r.target, r.lsn, r.n, {each} FROM f JOIN r ON r.target = f.target AND r.n = f.n + 1) SELECT target, lsn, {out} FROM f"


# ---- queues and flow control ---------------------------------------------------------------------------------


@query("ring_queue", L + f", {_R} SELECT target, lsn, (n - 1) % 5 < 3 AS accepted, CAST(least((n - 1) % 5 + 1, 3) AS BIGINT) AS held, CASE WHEN n % 5 = 0 THEN CAST(3 AS BIGINT) END AS drained FROM r")
def ring_queue(spark, sf_dir):
    """A ring of three: each event is pushed, every fifth drains it; what comes out is in the order it went in."""

    def step(ring: control.RingBuffer, r: dict) -> tuple:
        accepted, held = ring.try_push(r["lsn"]), len(ring.items)
        out = ring.drain() if r["n"] % 5 == 0 else None
        if out is not None and out != sorted(out):
            raise ValueError("a ring keeps its order")
        return accepted, held, None if out is None else len(out)

    return fold(_ordered(spark, sf_dir), ["target"], "n", lambda: control.RingBuffer(3), step, "accepted boolean, held long, drained long").select("target", "lsn", "accepted", "held", "drained")


_DUE = "{b} >= 100 OR ({b} > 0 AND r.us - {s} >= 7200000000)"


@query("flush_coordinator", _walk(
    f"CASE WHEN {_DUE.format(b='bytes', s='0')} THEN 1 END AS flushed, CASE WHEN {_DUE.format(b='bytes', s='0')} THEN 0 ELSE bytes END AS held, CASE WHEN {_DUE.format(b='bytes', s='0')} THEN us ELSE 0 END AS since, CASE WHEN {_DUE.format(b='bytes', s='0')} THEN 0 ELSE 1 END AS waiting",
    f"CASE WHEN {_DUE.format(b='f.held + r.bytes', s='f.since')} THEN f.waiting + 1 END, CASE WHEN {_DUE.format(b='f.held + r.bytes', s='f.since')} THEN 0 ELSE f.held + r.bytes END, CASE WHEN {_DUE.format(b='f.held + r.bytes', s='f.since')} THEN r.us ELSE f.since END, CASE WHEN {_DUE.format(b='f.held + r.bytes', s='f.since')} THEN 0 ELSE f.waiting + 1 END",
    "CAST(flushed AS BIGINT) AS flushed, CAST(waiting AS BIGINT) AS waiting"))
def flush_coordinator(spark, sf_dir):
    """Batches that go on at 100 bytes or two hours after the one before."""

    def step(c: control.Coordinator, r: dict) -> tuple:
        c.ring.try_push((r["lsn"], r["bytes"]))
        out = c.poll(r["us"])
        return None if out is None else len(out), len(c.batch)

    make = lambda: control.Coordinator(control.RingBuffer(8), control.FlushPolicy(100, 7_200_000_000))
    return fold(_ordered(spark, sf_dir), ["target"], "n", make, step, "flushed long, waiting long").select("target", "lsn", "flushed", "waiting")


@query("credit_flow", _walk("true AS granted, 3 AS left_", "f.left_ > 0, CASE WHEN f.left_ > 0 THEN f.left_ - 1 ELSE 0 END + CASE WHEN r.n % 10 = 0 THEN 4 ELSE 0 END", "granted, CAST(left_ AS BIGINT) AS credits"))
def credit_flow(spark, sf_dir):
    """Four credits, a top-up of at most a window after every tenth message."""

    def step(c: control.Credits, r: dict) -> tuple:
        granted = c.consume()
        if r["n"] % 10 == 0:
            c.replenish(6)
        return granted, c.left

    return fold(_ordered(spark, sf_dir), ["target"], "n", lambda: control.Credits(4), step, "granted boolean, credits long").select("target", "lsn", "granted", "credits")


@query("pending_cap", _walk("CASE WHEN op = 'delete' THEN 0 ELSE 1 END AS pending", "greatest(0, f.pending + CASE WHEN f.pending >= 3 THEN 0 ELSE 1 END - CASE WHEN r.op = 'delete' THEN 2 ELSE 0 END)", "CAST(pending AS BIGINT) AS pending, pending >= 3 AS paused"))
def pending_cap(spark, sf_dir):
    def step(c: control.PendingCap, r: dict) -> tuple:
        if not c.paused:
            c.sent()
        if r["op"] == "delete":
            c.acknowledged(2)
        return c.pending, c.paused

    return fold(_ordered(spark, sf_dir), ["target"], "n", lambda: control.PendingCap(3), step, "pending long, paused boolean").select("target", "lsn", "pending", "paused")


@query("gate_state", L + f", {_R}, g AS (SELECT target, lsn, coalesce(last_value(CASE tbl WHEN 'error' THEN 'manual' WHEN 'purchase' THEN 'lag' WHEN 'signup' THEN '' END IGNORE NULLS) OVER w, '') AS reason, count(*) FILTER (WHERE tbl IN ('error', 'purchase')) OVER w AS closings FROM r WINDOW w AS (PARTITION BY target ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT target, lsn, reason = '' AS is_open, nullif(reason, '') AS reason, closings FROM g")
def gate_state(spark, sf_dir):
    def step(g: control.Gate, r: dict) -> tuple:
        if r["tbl"] in ("error", "purchase"):
            g.close("manual" if r["tbl"] == "error" else "lag")
        elif r["tbl"] == "signup":
            g.open()
        return g.is_open, g.reason, g.closings

    return fold(_ordered(spark, sf_dir), ["target"], "n", control.Gate, step, "is_open boolean, reason string, closings long").select("target", "lsn", "is_open", "reason", "closings")


_FULL = "least(2.0::DOUBLE, {t} + (r.us / 1000000.0::DOUBLE - {a}) * 0.000244140625::DOUBLE)"


@query("token_bucket", _walk(
    "true AS allowed, 1.0::DOUBLE AS tokens, us / 1000000.0::DOUBLE AS at",
    f"{_FULL.format(t='f.tokens', a='f.at')} >= 1, {_FULL.format(t='f.tokens', a='f.at')} - CASE WHEN {_FULL.format(t='f.tokens', a='f.at')} >= 1 THEN 1 ELSE 0 END, r.us / 1000000.0::DOUBLE", "allowed"))
def token_bucket(spark, sf_dir):
    """A token every 4,096 seconds, two at most."""
    step = lambda b, r: (b.acquire(r["us"] / 1_000_000),)
    return fold(_ordered(spark, sf_dir), ["target"], "n", lambda: control.TokenBucket(2**-12, 2), step, "allowed boolean").select("target", "lsn", "allowed")


@query("memory_budget", _walk("greatest(0, bytes - CASE WHEN op = 'delete' THEN 40 ELSE 0 END) AS used", "greatest(0, f.used + r.bytes - CASE WHEN r.op = 'delete' THEN 40 ELSE 0 END)", "CAST(used AS BIGINT) AS used, used > 60 AS exceeded, used > 48 AS warning, CAST(greatest(0, 60 - used) AS BIGINT) AS remaining"))
def memory_budget(spark, sf_dir):
    def step(m: control.MemoryBudget, r: dict) -> tuple:
        m.allocate(r["bytes"])
        if r["op"] == "delete":
            m.release(40)
        return m.used, m.exceeded, m.warning, m.remaining

    return fold(_ordered(spark, sf_dir), ["target"], "n", lambda: control.MemoryBudget(60), step, "used long, exceeded boolean, warning boolean, remaining long").select("target", "lsn", "used", "exceeded", "warning", "remaining")


@query("slot_lifecycle", L + f", {_R}, s AS (SELECT *, coalesce(last_value(CASE tbl WHEN 'signup' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY target ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM r) SELECT target, lsn, CASE WHEN tbl = 'error' THEN 'dropped' WHEN there THEN 'there' WHEN tbl = 'signup' THEN 'made' ELSE 'missing' END AS outcome, CASE WHEN tbl = 'signup' AND NOT there THEN lsn END AS position FROM s")
def slot_lifecycle(spark, sf_dir):
    """A sign-up makes a slot, an error drops it, anything else needs it."""
    from tidelog.errors import SlotMissing

    def step(slots: control.SlotManager, r: dict) -> tuple:
        if r["tbl"] == "error":
            slots.drop("s")
            return "dropped", None
        try:
            made = slots.ensure("s", r["lsn"], r["tbl"] == "signup")
        except SlotMissing:
            return "missing", None
        return ("there", None) if made is None else ("made", made)

    return fold(_ordered(spark, sf_dir), ["target"], "n", control.SlotManager, step, "outcome string, position long").select("target", "lsn", "outcome", "position")


@query("lifecycle_health", "SELECT * FROM (VALUES ('starting', '{\"ready\":false,\"live\":true}'), ('running', '{\"ready\":true,\"live\":true}'), ('draining', '{\"ready\":false,\"live\":true}'), ('stopped', '{\"ready\":false,\"live\":false}')) AS t(state, health)")
def lifecycle_health(spark, sf_dir):
    life, rows = control.Lifecycle(), []
    for state in control.Lifecycle.ORDER:
        life.to(state)
        rows.append((state, delivery.health(life.ready, life.live)))
    return spark.createDataFrame(rows, "state string, health string")


@query("consumer_registry", L + ", a AS (SELECT user_id AS consumer, lsn, tbl, max(lsn) FILTER (WHERE tbl = 'error' AND lsn % 40 < 8) OVER (PARTITION BY user_id) AS gone FROM log) SELECT consumer, max(lsn) FILTER (WHERE tbl IN ('view', 'click')) AS committed FROM a WHERE gone IS NULL OR lsn > gone GROUP BY consumer")
def consumer_registry(spark, sf_dir):
    t = F.col("table.table")
    action = F.when((t == "error") & (F.col("lsn") % 40 < 8), "unregister").when(t.isin("view", "click"), "commit").otherwise("register")
    return offsets.registered(change_log(spark, sf_dir).select(F.col("xid").alias("consumer"), F.col("lsn").alias("seq"), action.alias("action"), "lsn"))


@query("offset_state", "WITH a AS (SELECT user_id AS consumer, event_id AS seq, event_id * 7919 % 1000 AS lsn FROM events WHERE event_id < 4000), m AS (SELECT *, max(lsn) OVER (PARTITION BY consumer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM a) SELECT consumer, max(lsn) AS committed, count(*) FILTER (WHERE coalesce(lsn >= cur, true)) AS accepted, count(*) FILTER (WHERE lsn < cur) AS refused FROM m GROUP BY consumer")
def offset_state(spark, sf_dir):
    """Offsets as the state of a stream: commits arrive in two files, and a refused one changes nothing."""
    path = _shared(spark, "offsets")
    attempts = _attempts(spark, sf_dir).where("seq < 4000")
    for k in range(2):
        attempts.where(f"seq div 2000 = {k}").coalesce(1).write.parquet(f"{path}/in/part={k}")
    stream = spark.readStream.schema("consumer long, seq long, lsn long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    done = log_stream.committed_offsets(stream.select(F.col("consumer").cast("string").alias("consumer"), "seq", "lsn")).writeStream.outputMode("update").foreachBatch(write)
    done.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{path}/out")
    return found.groupBy(F.col("consumer").cast("long").alias("consumer")).agg(F.max("committed").alias("committed"), F.sum("accepted").alias("accepted"), F.sum("refused").alias("refused"))


@query("wal_frames", _FOLD + f", {_R.replace('strlen(props)', 'strlen(props) + 12')}, p AS (SELECT r.*, log.props FROM r JOIN log ON r.lsn = log.lsn)" + """,
f AS (SELECT target, lsn, n, 0 AS segment, CASE WHEN bytes >= 300 THEN 0 ELSE bytes END AS total, CASE WHEN bytes >= 300 THEN 1 ELSE 0 END AS next FROM r WHERE n = 1
UNION ALL SELECT r.target, r.lsn, r.n, f.next, CASE WHEN total + r.bytes >= 300 THEN 0 ELSE total + r.bytes END, CASE WHEN total + r.bytes >= 300 THEN f.next + 1 ELSE f.next END FROM f JOIN r ON r.target = f.target AND r.n = f.n + 1)
SELECT f.target, f.lsn, CAST(f.segment AS BIGINT) AS segment, lower(lpad(to_hex(p.bytes - 4), 8, '0') || lpad(to_hex(f.lsn), 16, '0') || hex(encode(p.props))) AS frame FROM f JOIN p ON f.lsn = p.lsn""")
def wal_frames(spark, sf_dir):
    rows = change_log(spark, sf_dir).select(F.col("xid").alias("target"), "lsn", F.col("data.props").alias("payload"))
    return log.wal_frames(rows, 300, ["target"]).select("target", "lsn", "segment", hashing.hex_text(F.col("frame")).alias("frame"))


# ---- frames --------------------------------------------------------------------------------------------------

_REL = 40


def _all_kinds(spark, sf_dir) -> DataFrame:
    """The log as frames: inserts, updates with an old key and without, deletes, truncates, DDL messages, commits."""
    head = [frames.begin_frame(77, 1_700_000_000_000_000, 9), frames.relation_frame(_REL, "public", "events", [("user_id", 20), ("props", 25)]), frames.relation_frame(_REL + 1, "public", "other", [("id", 20)])]
    e = table(spark, sf_dir, "events")
    number = lambda value, n: F.lpad(F.hex(value), 2 * n, "0")
    byte = lambda tag: F.lit(tag.hex())
    value = lambda c: F.concat(byte(b"t"), number(F.octet_length(c), 4), F.hex(c.cast("binary")))
    user, props = value(F.col("user_id").cast("string")), value(F.col("props"))
    two, rel = byte(struct.pack(">H", 2)), byte(struct.pack(">I", _REL))
    sent = F.when(F.col("event_id") % 5 == 0, byte(b"u")).otherwise(props)
    key = F.concat(byte(b"K"), two, user, byte(b"n"))
    content = F.concat(F.lit("ADD_COLUMN|public.events|ALTER TABLE public.events ADD COLUMN c"), F.col("event_id").cast("string"))
    kinds = (
        F.when(F.col("event_id") % 11 == 0, F.concat(byte(b"M\1"), number(F.col("event_id"), 8), byte(b"ddl\0"), number(F.octet_length(content), 4), F.hex(content.cast("binary"))))
        .when(F.col("event_id") % 13 == 0, F.concat(byte(b"C\0"), number(F.col("event_id") + 5, 8), number(F.col("event_id"), 8), number(F.lit(0), 8)))
        .when(F.col("event_type") == "signup", F.concat(byte(b"I"), rel, byte(b"N"), two, user, props))
        .when(F.col("event_type") == "view", F.concat(byte(b"U"), rel, key, byte(b"N"), two, user, sent))
        .when(F.col("event_type") == "click", F.concat(byte(b"U"), rel, byte(b"N"), two, user, sent))
        .when(F.col("event_type") == "purchase", F.concat(byte(b"D"), rel, key))
        .otherwise(F.lit((b"T" + struct.pack(">IB", 2, 0) + struct.pack(">II", _REL, _REL + 1)).hex()))
    )
    rows = e.select((F.col("event_id") + 10).alias("seq"), F.col("event_id").alias("lsn"), F.unhex(kinds).alias("data"), F.pmod(F.col("user_id"), F.lit(8)).alias("segment"))
    starts = [(k, 0, bytearray(d), s) for s in range(8) for k, d in enumerate(head)]
    return spark.createDataFrame(starts, "seq long, lsn long, data binary, segment long").unionByName(rows)


_K = L + ", k AS (SELECT *, op IN ('insert', 'update') AS has, tbl = 'view' OR tbl = 'purchase' AS old, tbl IN ('view', 'click') AND lsn % 5 = 0 AS kept FROM log WHERE lsn % 11 <> 0 AND lsn % 13 <> 0)"


@query("frames_changes", _K + " SELECT lsn, op, 'public.events' AS name, CASE WHEN has THEN user_id::VARCHAR END AS after_user, CASE WHEN has AND NOT kept THEN props END AS after_props, CASE WHEN old THEN user_id::VARCHAR END AS before_user, CASE WHEN kept THEN 'props' WHEN has THEN '' END AS unchanged FROM k UNION ALL SELECT lsn, op, 'public.other', NULL, NULL, NULL, NULL FROM k WHERE op = 'truncate'")
def frames_changes(spark, sf_dir):
    """Updates with and without an old key, deletes, truncates of two tables, values that were not sent."""
    e = frames.decode(_all_kinds(spark, sf_dir))
    return e.select("lsn", "op", qualified().alias("name"), text(F.col("after"), "user_id").alias("after_user"), text(F.col("after"), "props").alias("after_props"), text(F.col("before"), "user_id").alias("before_user"), F.array_join("toast_unchanged", ",").alias("unchanged"))


@query("frames_carried_forward", _K + ", s AS (SELECT lsn, op, user_id, has, last_value(CASE WHEN has AND NOT kept THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS props FROM k) SELECT lsn, op, CASE WHEN has THEN props END AS props FROM s WHERE op <> 'truncate'")
def frames_carried_forward(spark, sf_dir):
    e = frames.decode(_all_kinds(spark, sf_dir)).where("op <> 'truncate'")
    return frames.carried_forward(e, "user_id").select("lsn", "op", text(F.col("after"), "props").alias("props"))


@query("frames_messages", "SELECT event_id AS lsn, 'public.events' AS \"table\", 'AddColumn' AS kind, 'c' || event_id AS detail FROM events WHERE event_id % 11 = 0")
def frames_messages(spark, sf_dir):
    return ddl.parse(frames.ddl_frames(_all_kinds(spark, sf_dir))).select("lsn", "table", "kind", "detail")


@query("frames_commits", "SELECT event_id AS lsn, event_id + 5 AS final_lsn FROM events WHERE event_id % 13 = 0 AND event_id % 11 <> 0")
def frames_commits(spark, sf_dir):
    return frames.commits(_all_kinds(spark, sf_dir))


@query("ddl_capture", "SELECT event_id AS lsn, CASE event_id % 2 WHEN 0 THEN 'ALTER_TABLE|public.' || event_type || '|ALTER TABLE x' ELSE 'DROP_TABLE|public.' || event_type || '|DROP TABLE' END AS content FROM events")
def ddl_capture(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tag = F.when(F.col("event_id") % 2 == 0, "ALTER TABLE").otherwise("DROP TABLE")
    statement = F.when(F.col("event_id") % 2 == 0, "ALTER TABLE x").otherwise("DROP TABLE")
    return e.select(F.col("event_id").alias("lsn"), ddl.captured(tag, F.concat(F.lit("public."), F.col("event_type")), statement).alias("content"))


@query("schema_catalog", "SELECT 'public' AS schema, table_name AS \"table\", column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type_name, column_name = 'o_orderkey' AS is_primary_key, CAST(ordinal_position AS INT) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'events')")
def schema_catalog(spark, sf_dir):
    tables = {f"public.{t}": table(spark, sf_dir, t) for t in ("orders", "customer", "events")}
    return probes.catalog(spark, tables, {"public.orders": ["o_orderkey"]}).select("schema", "table", "name", "type_name", "is_primary_key", "ordinal_position")


@query("probe_exists", "SELECT count(*) FILTER (WHERE event_type = 'click') > 0 AS click, count(*) FILTER (WHERE event_type = 'refund') > 0 AS refund FROM events")
def probe_exists(spark, sf_dir):
    names = table(spark, sf_dir, "events").select("event_type")
    return probes.exists(names, "event_type", "click").select(F.col("found").alias("click")).crossJoin(F.broadcast(probes.exists(names, "event_type", "refund").select(F.col("found").alias("refund"))))  # one row


@query("snapshot_pinned", "SELECT 'public.nation' AS tbl, n_name AS name, 5 AS lsn FROM nation UNION ALL SELECT 'public.region', r_name, 5 FROM region")
def snapshot_pinned(spark, sf_dir):
    """Two tables as their files are at one moment."""
    rows = snapshot.pinned(spark, {f"public.{t}": f"{sf_dir}/{t}.parquet" for t in ("nation", "region")}, 5)
    return rows.select(qualified().alias("tbl"), F.coalesce(text(F.col("after"), "n_name"), text(F.col("after"), "r_name")).alias("name"), F.col("lsn").cast("int"))


# ---- delivery ------------------------------------------------------------------------------------------------

_BATCHES = L + ", b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY lsn) - 1) // 25 AS batch FROM log), p AS (SELECT user_id AS target, batch, count(*) AS events, '[' || string_agg('{\"lsn\":' || lsn || ',\"xid\":' || xid || ',\"op\":\"' || op || '\",\"table\":\"' || name || '\",\"ts\":' || us || '}', ',' ORDER BY lsn) || ']' AS payload FROM b GROUP BY user_id, batch)"
_PADS = [bytes(b ^ pad for b in b"test-secret".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


def _payloads(spark, sf_dir) -> DataFrame:
    return delivery.payloads(batching.count_batches(change_log(spark, sf_dir).withColumn("target", F.col("xid")), 25, ["target"]), ["target", "batch"])


@query("signed_requests", _BATCHES + f" SELECT target, batch, 'X-Tidelog-Events: ' || events AS events_header, 'sha256=' || sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(payload)))) AS signature FROM p")
def signed_requests(spark, sf_dir):
    return delivery.signed(_payloads(spark, sf_dir), "test-secret").select("target", "batch", F.concat(F.lit(f"{delivery.EVENTS_HEADER}: "), F.col("events_header")).alias("events_header"), F.col("signature"))


@query("dispatch", _BATCHES + ", o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY batch) AS n FROM p) SELECT target, batch, CASE WHEN target % 5 <> 0 THEN 1 WHEN n <= 2 THEN 3 WHEN n = 3 THEN 1 ELSE 0 END AS attempts, CASE WHEN target % 5 <> 0 THEN NULL WHEN n <= 3 THEN 'status 503' ELSE 'circuit open' END AS error FROM o")
def dispatch(spark, sf_dir):
    """Every fifth target fails: two batches are tried three times, the seventh failure opens the breaker."""
    send = lambda target, payload, headers: 503 if int(target) % 5 == 0 else 200
    done = delivery.deliver(_payloads(spark, sf_dir), send, 3, "test-secret", f"{_shared(spark, 'delivery')}/results", threshold=7, timeout_ms=3_600_000, wait=lambda s: None)
    return done.select(F.col("target").cast("long").alias("target"), "batch", F.col("attempts").cast("int").alias("attempts"), "error")


@query("undelivered", _BATCHES + " SELECT target, batch, events, payload FROM p WHERE target % 5 = 0")
def undelivered(spark, sf_dir):
    send = lambda target, payload, headers: 503 if int(target) % 5 == 0 else 200
    rows = _payloads(spark, sf_dir)
    done = delivery.deliver(rows, send, 2, None, f"{_shared(spark, 'delivery')}/results", wait=lambda s: None)
    return delivery.undelivered(done, rows).select(F.col("target").cast("long").alias("target"), "batch", "events", "payload")


@query("full_payload", L + f" SELECT lsn, json_extract_string(j, '$.after[2].value') AS props FROM (SELECT lsn, CASE WHEN {HAS} THEN '{{\"after\":[null,null,{{\"value\":' || to_json(props) || '}}]}}' END AS j FROM log)")
def full_payload(spark, sf_dir):
    return change_log(spark, sf_dir).select("lsn", F.get_json_object(delivery.full_json(), "$.after[2].value").alias("props"))


@query("exposition", L + " SELECT 'tidelog_events{op=\"' || op || '\",tbl=\"' || tbl || '\"} ' || count(*) AS line FROM log GROUP BY op, tbl")
def exposition(spark, sf_dir):
    return metrics.exposition(metrics.counters(change_log(spark, sf_dir).withColumn("tbl", F.col("table.table")), ["op", "tbl"]), "events", ["op", "tbl"])


@query("consumer_gauges", L + ", c AS (SELECT max(lsn) AS committed FROM log WHERE tbl = 'view' GROUP BY user_id), h AS (SELECT max(lsn) AS head FROM log) SELECT 'active_consumers' AS name, count(*) AS value FROM c UNION ALL SELECT 'head', head FROM h UNION ALL SELECT 'lag', (SELECT head FROM h) - min(committed) FROM c")
def consumer_gauges(spark, sf_dir):
    e = change_log(spark, sf_dir)
    done = offsets.committed(e.where("`table`.`table` = 'view'").select(F.col("xid").alias("consumer"), "lsn"))
    return metrics.consumer_gauges(done, probes.head(e))


# ---- log, encryption, streams --------------------------------------------------------------------------------


@query("log_tenants", L + " SELECT lsn, 'even' AS tenant FROM log WHERE lsn % 2 = 0 AND lsn BETWEEN 200 AND 700")
def log_tenants(spark, sf_dir):
    path, e = _shared(spark, "log"), change_log(spark, sf_dir).drop("data", "ts")
    for k, tenant in enumerate(("even", "odd")):
        log.append(e.where(F.col("lsn") % 2 == k), path, tenant, span=1000)
    return log.read(spark, path, "even", 200, 700, span=1000).select("lsn", "tenant")


@query("last_wins", L + " SELECT lsn, CASE WHEN lsn % 3 = 0 THEN 'second' ELSE op END AS op FROM log WHERE lsn < 3000")
def last_wins(spark, sf_dir):
    """Every third event is written twice under its key; a read gives the later row."""
    path, e = _shared(spark, "log"), change_log(spark, sf_dir).drop("data", "ts").where("lsn < 3000")
    log.append(e, path, "acme", span=1000, ingest=1)
    log.append(e.where("lsn % 3 = 0").withColumn("op", F.lit("second")), path, "acme", span=1000, ingest=2)
    return log.read(spark, path, "acme", last_wins=True).select("lsn", "op")


@query("nonce_unique", "SELECT CAST(4 * count(*) AS BIGINT) AS sealed, CAST(4 * count(*) AS BIGINT) AS nonces FROM nation")
def nonce_unique(spark, sf_dir):
    """Rows of a snapshot share their position; each sealed value of each image still has a nonce of its own."""
    n = table(spark, sf_dir, "nation")
    image = row(key=F.col("n_nationkey"), name=F.col("n_name"))
    rows = snapshot.snapshot(n, "public", "nation", 7, ["n_nationkey"]).limit(0).unionByName(n.select(F.lit(7).cast("long").alias("lsn"), F.lit(0).cast("long").alias("xid"), F.lit("update").alias("op"), table_id("public", "nation").alias("table"), F.lit("0" * 16).alias("schema_fingerprint"), image.alias("after"), image.alias("before"), F.lit(0).cast("long").alias("commit_timestamp_us")))
    for im in ("after", "before"):
        rows = crypto.encrypt(rows, ["key", "name"], F.lit("test-only-key-16").cast("binary"), im)
    values = rows.select(F.explode(F.concat("after", "before")).alias("c")).select(F.substring(F.unbase64("c.value"), 1, 12).alias("nonce"))
    return values.agg(F.count(F.lit(1)).alias("sealed"), F.countDistinct("nonce").alias("nonces"))


@query("schema_gate", L + ", s AS (SELECT tbl AS fp, min(ts) AS known_at FROM log WHERE tbl IN ('click', 'view') GROUP BY tbl) SELECT log.lsn, s.fp IS NOT NULL AS known FROM log LEFT JOIN s ON log.tbl = s.fp AND s.known_at <= log.ts + INTERVAL 5 SECOND AND s.known_at >= log.ts - INTERVAL 1 DAY")
def schema_gate(spark, sf_dir):
    e = change_log(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withColumn("schema_fingerprint", F.col("table.table"))
    known = e.where("schema_fingerprint in ('click', 'view')").groupBy(F.col("schema_fingerprint").alias("fingerprint")).agg(F.min("at").alias("at"))
    return log_stream.gated_by_schema(e, known).select("lsn", F.col("schema_known").alias("known"))


@query("idempotent_stream", L + " SELECT lsn, op FROM log WHERE lsn < 3000")
def idempotent_stream(spark, sf_dir):
    """Every event arrives twice, in other files; it is applied once."""
    path = _shared(spark, "twice")
    e = change_log(spark, sf_dir).where("lsn < 3000").select("lsn", "op", F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"))
    for k in range(2):
        e.repartition(2 + k, "lsn").write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    done = log_stream.idempotent(stream, ["lsn"], "1 hour").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("lsn", "op")


@query("sliding_windows", L + ", w AS (SELECT op, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS start FROM log, range(0, 2) AS t(k)) SELECT start, op, count(*) AS n FROM w GROUP BY start, op")
def sliding_windows(spark, sf_dir):
    e = change_log(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    return log_stream.windowed_counts(e, "2 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "op", "n")


@query("session_windows", L + ", g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true) AS fresh FROM log), s AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, session")
def session_windows(spark, sf_dir):
    e = change_log(spark, sf_dir).select(F.col("xid").alias("user_id"), F.col("ts").cast("timestamp").alias("at"))
    found = log_stream.session_counts(e, ["user_id"], "6 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("late_events", L + " SELECT lsn FROM log WHERE lsn < 2000 AND lsn % 50 <> 7")
def late_events(spark, sf_dir):
    """A stream in three batches whose last has events far behind the watermark: those, every fiftieth, are dropped."""
    path = _shared(spark, "late")
    base = F.lit(1_700_000_000)
    e = change_log(spark, sf_dir).where("lsn < 2000").select("lsn")
    on_time = e.where("lsn % 50 <> 7").withColumn("at", F.timestamp_seconds(base + F.col("lsn")))
    late = e.where("lsn % 50 = 7").withColumn("at", F.timestamp_seconds(base - 100_000 + F.col("lsn")))
    for k, rows in enumerate((on_time.where("lsn < 500"), on_time.where("lsn between 500 and 999"), on_time.where("lsn >= 1000").unionByName(late))):
        rows.coalesce(1).write.parquet(f"{path}/in/part={k}")
    stream = spark.readStream.schema("lsn long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    done = log_stream.idempotent(stream.select("lsn", "at"), ["lsn"], "10 minutes").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("lsn")

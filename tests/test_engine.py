"""Folds against Python loops, streams, and the log on disk."""

import base64
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.operators import batching, control, delivery, log, offsets
from tidelog.plans.rules import ReadFilter
from tidelog.schema import CHANGE_SCHEMA, event_size, typed_by_oid
from tidelog.sources import snapshot
from tidelog.streaming import log_stream


def test_byte_batches_like_a_loop(spark):
    rng = random.Random(1)
    rows = [(k % 3, k, rng.randint(0, 60)) for k in range(300)]
    df = spark.createDataFrame(rows, "t long, lsn long, bytes long").repartition(5)
    got = {r.lsn: r.batch for r in batching.byte_batches(df, 100, ["t"]).collect()}
    for t in range(3):
        total = number = 0
        for _, lsn, size in (r for r in rows if r[0] == t):
            assert got[lsn] == number
            total += size
            if total >= 100:
                total, number = 0, number + 1


def test_circuit_like_the_model(spark):
    rng = random.Random(2)
    rows = [(f"t{k % 4}", k, k * 10, rng.random() < 0.5) for k in range(400)]
    got = {r.seq: r for r in delivery.circuit(spark.createDataFrame(rows, "target string, seq long, at_us long, ok boolean"), 2, 100).collect()}
    breakers = {}
    for target, seq, at, ok in rows:
        b = breakers.setdefault(target, control.CircuitBreaker(2, 100))
        allowed = b.allow(at)
        if allowed:
            b.report(ok, at)
        assert (got[seq].allowed, got[seq].state) == (allowed, b.state)


def test_deliver(spark):
    rows = spark.createDataFrame([("good", 0, 1, "[]"), ("bad", 1, 1, "[]"), ("broken", 2, 1, "[]")], "target string, batch long, events long, payload string")

    def send(target, payload, headers):
        if target == "broken":
            raise OSError("no route")
        return 200 if target == "good" else 503

    got = {r.target: r for r in delivery.deliver(rows, send, 3, "secret", initial_ms=1).collect()}
    assert got["good"].error is None and got["good"].attempts == 1
    assert got["bad"].error == "status 503" and got["bad"].attempts == 3 and "no route" in got["broken"].error


def test_delivery_chain(spark, tmp_path):
    """Waits that double, a breaker that opens, dead letters; sent once although the result is read twice."""
    rows = spark.createDataFrame([(t, k, 1, f"[{k}]") for t in ("good", "bad") for k in range(4)], "target string, batch long, events long, payload string").repartition(3)
    calls, waits = str(tmp_path / "calls"), str(tmp_path / "waits")

    def send(target, payload, headers):
        with open(calls, "a") as f:
            f.write(f"{target} {payload} {headers['X-Event-ID']}\n")
        return 200 if target == "good" else 500

    def wait(seconds):
        with open(waits, "a") as f:
            f.write(f"{seconds}\n")

    done = delivery.deliver(rows, send, 3, "secret", f"file://{tmp_path}/results", initial_ms=10, longest_ms=15, threshold=4, wait=wait)
    got = {(r.target, r.batch): (r.attempts, r.error) for r in done.collect()}
    assert got == {("good", k): (1, None) for k in range(4)} | {("bad", 0): (3, "status 500"), ("bad", 1): (1, "status 500"), ("bad", 2): (0, "circuit open"), ("bad", 3): (0, "circuit open")}
    dead = delivery.undelivered(done, rows).collect()
    assert sorted((r.target, r.batch, r.payload) for r in dead) == [("bad", k, f"[{k}]") for k in range(4)]
    sent = open(calls).read().splitlines()
    assert [x for x in sent if x.startswith("good")] == [f"good [{k}] good-{k}" for k in range(4)] and len(sent) == 8
    assert open(waits).read().split() == ["0.01", "0.015", "0.01"]


def test_last_write_wins(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    event = lambda k, v: (k, 1, "insert", ("public", "t"), "0" * 16, [("a", 0, v)], None, 0)
    log.append(spark.createDataFrame([event(k, f"old{k}") for k in range(50)] + [event(3, "later")], CHANGE_SCHEMA).coalesce(1), path, "a", span=10)
    log.append(spark.createDataFrame([event(k, f"new{k}") for k in range(20, 30)], CHANGE_SCHEMA).coalesce(1), path, "a", span=10)
    log.append(spark.createDataFrame([event(5, "other")], CHANGE_SCHEMA), path, "b", span=10)
    assert log.read(spark, path, "a").count() == 61
    for _ in range(2):
        got = {r.lsn: r.after[0].value for r in log.read(spark, path, "a", last_wins=True).collect()}
        assert got == {k: f"new{k}" if 20 <= k < 30 else "later" if k == 3 else f"old{k}" for k in range(50)}
    both = log.read(spark, path, last_wins=True)
    assert both.count() == 51 and both.where("tenant = 'b'").count() == 1


def test_append_without_dealing(spark, tmp_path):
    rows = spark.createDataFrame([(k * 37 % 500, 1, "insert", ("public", "t"), "0" * 16, None, None, 0) for k in range(500)], CHANGE_SCHEMA).repartition(3)
    log.append(rows, f"file://{tmp_path}/log", "a", span=100, deal=False)
    found = log.read(spark, f"file://{tmp_path}/log", "a", 100, 299, span=100)
    assert sorted(r.lsn for r in found.collect()) == list(range(100, 300)) and len(list(tmp_path.glob("log/tenant=a/*/*.parquet"))) == 15
    for file in tmp_path.glob("log/tenant=a/*/*.parquet"):
        own = [r.lsn for r in spark.read.parquet(f"file://{file}").collect()]
        assert own == sorted(own)


def test_offset_store(spark, tmp_path, monkeypatch):
    from tidelog.errors import OffsetRegression

    store = offsets.FileOffsetStore(spark, f"file://{tmp_path}/offsets")
    assert store.load() == {} and store.resume("a") == 0
    store.commit("a", 5)
    store.register("b")
    assert (store.load(), store.resume("a"), store.resume("b")) == ({"a": 5, "b": -1}, 6, 0)
    with pytest.raises(OffsetRegression):
        store.commit("a", 4)
    # a crash before the rename, and one right after the claim, leave what was there
    real = store._fs
    for point in ("create", "rename"):

        class Crashing:
            def __getattr__(self, name):
                if name == point and (point == "rename" or self.claimed):
                    raise RuntimeError("crash")
                self.claimed |= name == "create"
                return getattr(real, name)

            claimed = False

        monkeypatch.setattr(store, "_fs", Crashing())
        with pytest.raises(RuntimeError):
            store.commit("a", 9)
        monkeypatch.setattr(store, "_fs", real)
        assert offsets.FileOffsetStore(spark, f"file://{tmp_path}/offsets").load() == {"a": 5, "b": -1}
    # a writer that is overtaken between its reading and its writing applies its change again
    other, first = offsets.FileOffsetStore(spark, f"file://{tmp_path}/offsets"), store._claim

    def slow(number):
        monkeypatch.setattr(store, "_claim", first)
        assert first(number)
        other.commit("c", 7)
        return True

    monkeypatch.setattr(store, "_claim", slow)
    store.commit("a", 8)
    assert store.load() == {"a": 8, "b": -1, "c": 7}
    for k in range(20):
        store.commit("a", 10 + k)
    store.unregister("b")
    assert store.load() == {"a": 29, "c": 7} and len(list((tmp_path / "offsets").glob("*.json"))) <= store.KEPT


def test_nonces_differ(spark):
    from tidelog.operators import crypto
    from tidelog.schema import row, table_id

    key, other = F.lit("test-only-key-16").cast("binary"), F.lit("another-key-1616").cast("binary")
    image = row(a=F.col("id") % 3, b=F.lit("same"))
    rows = spark.range(6).select(F.lit(5).alias("lsn"), F.lit(0).alias("xid"), table_id("s", "t").alias("table"), image.alias("after"), image.alias("before"))
    nonces = {}
    for name, k in (("one", key), ("two", other)):
        sealed = crypto.encrypt(crypto.encrypt(rows, ["a", "b"], k), ["a", "b"], k, "before")
        for x in sealed.collect():
            for im in ("after", "before"):
                for c, plain in zip(x[im], ("a", "b"), strict=True):
                    nonces.setdefault(base64.b64decode(c.value)[:12], set()).add((name, im, plain, c.value))
    assert all(len(v) == 1 for v in nonces.values()) and len(nonces) == 2 * 2 * (3 + 1)
    opened = crypto.decrypt(crypto.rotate(crypto.encrypt(rows, ["a"], key), ["a"], key, other), ["a"], other)
    assert [r.after[0].value for r in opened.orderBy(F.col("after")[0]["value"]).collect()] == ["0", "0", "1", "1", "2", "2"]


def test_pinned_snapshot(spark, tmp_path):
    paths = {f"public.{t}": f"file://{tmp_path}/{t}" for t in ("a", "b")}
    for k, path in enumerate(paths.values()):
        spark.range(3 + k).write.parquet(path)
    rows = snapshot.pinned(spark, paths, 7)
    spark.range(100, 110).write.mode("append").parquet(paths["public.a"])
    assert sorted((r.table.table, r.after[0].value, r.lsn) for r in rows.collect()) == [("a", str(k), 7) for k in range(3)] + [("b", str(k), 7) for k in range(4)]


def test_stream_restart_is_idempotent(spark, tmp_path):
    event = lambda k: (k, 1, "insert", ("public", "t"), "0" * 16, [("a", 0, str(k))], None, 0)
    base = f"file://{tmp_path}"
    for part in range(3):
        spark.createDataFrame([event(k) for k in range(part * 10, part * 10 + 10)], CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = log_stream.change_files(spark, f"{base}/in", CHANGE_SCHEMA, 1)
        log_stream.to_log(stream, f"{base}/log", f"{base}/checkpoint")
        log_stream.to_log(log_stream.change_files(spark, f"{base}/in", CHANGE_SCHEMA, 1), f"{base}/log", f"{base}/checkpoint")
        assert sorted(r.lsn for r in log_stream.batches(spark, f"{base}/log").collect()) == list(range(part * 10 + 10))


def test_offset_state_stream(spark, tmp_path):
    out = []
    for part, rows in enumerate(([("a", 1, 5), ("a", 2, 3), ("b", 1, 1)], [("a", 3, 5), ("a", 4, 9), ("b", 2, 0)])):
        pd.DataFrame(rows, columns=["consumer", "seq", "lsn"]).to_parquet(tmp_path / f"{part}.parquet")
        src = spark.readStream.schema("consumer string, seq long, lsn long").parquet(f"file://{tmp_path}/*.parquet")
        q = log_stream.committed_offsets(src).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    last = {r.consumer: r for r in out}
    assert last["a"].committed == 9 and last["b"].committed == 1 and last["b"].refused == 1


def test_append_prune_collect(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = [(k, 1, "insert", ("public", "t"), "0" * 16, None, None, 0) for k in range(0, 1000, 7)]
    for tenant in ("a", "b"):
        log.append(spark.createDataFrame(rows, CHANGE_SCHEMA), path, tenant, span=100)
    found = log.read(spark, path, "a", 250, 449, span=100)
    assert sorted(r.lsn for r in found.collect()) == [r[0] for r in rows if 250 <= r[0] <= 449]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant" in plan and "GreaterThanOrEqual(lsn,250)" in plan
    own = ReadFilter(("public.t", "public.u")).apply(log.read(spark, path, "a"))
    assert own.count() == len(rows) and "EqualTo(table.table,t)" in own._jdf.queryExecution().executedPlan().toString()
    assert log.collect_garbage(spark, path, "a", 350, span=100) == 3
    assert min(r.lsn for r in log.read(spark, path, "a").collect()) >= 300 and log.read(spark, path, "b").count() == len(rows)


def test_snapshot_types_and_size(spark):
    df = spark.createDataFrame([(1, True, None)], "id long, ok boolean, gone string")
    rows = snapshot.snapshot(df, "public", "t", 9)
    r = rows.first()
    assert [(c.name, c.value) for c in r.after] == [("id", "1"), ("ok", "true"), ("gone", None)] and r.before is None
    assert rows.select(event_size(0).alias("n")).first().n == 7 + 8 + 5
    t = rows.select(typed_by_oid(F.col("after"), {"id": 20, "ok": 16, "gone": 1700}).alias("t")).first().t
    assert (t.id, t.ok, t.gone) == (1, True, None)


def test_watermark_empty(spark):
    none = spark.createDataFrame([], "consumer string, committed long")
    assert offsets.watermark(none).first()[0] == 0
    most = spark.createDataFrame([("a", 9_223_372_036_854_775_807)], "consumer string, committed long")
    assert offsets.watermark(most).first()[0] == 0


def test_schema_gate_and_windows(spark):
    at = "timestamp '2024-01-01 00:00:0{}'"
    events = spark.sql(f"select * from values (1, 'aa', {at.format(1)}), (2, 'bb', {at.format(1)}), (3, 'cc', {at.format(1)}) as e(lsn, schema_fingerprint, at)")
    schemas = spark.sql(f"select * from values ('aa', {at.format(0)}), ('bb', {at.format(5)}), ('cc', {at.format(9)}) as s(fingerprint, at)")
    got = {r.lsn: r.schema_known for r in log_stream.gated_by_schema(events, schemas).collect()}
    assert got == {1: True, 2: True, 3: False}
    rows = spark.sql("select * from values ('insert', timestamp '2024-01-01 00:10:00'), ('insert', timestamp '2024-01-01 00:50:00'), ('delete', timestamp '2024-01-01 01:10:00') as e(op, at)")
    got = {(r.start.hour, r.op): r.n for r in log_stream.windowed_counts(rows).collect()}
    assert got == {(0, "insert"): 2, (1, "delete"): 1}
    assert log_stream.windowed_counts(rows, "1 hour", "30 minutes").count() == 5


def test_idempotent_stream(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.sql("select id % 5 as lsn, timestamp '2024-01-01 00:00:00' as at from range(20)").write.parquet(f"{base}/in")
    stream = log_stream.idempotent(spark.readStream.schema("lsn long, at timestamp").parquet(f"{base}/in"), ["lsn"], "1 hour")
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.lsn for r in spark.read.parquet(f"{base}/out").collect()) == [0, 1, 2, 3, 4]


def test_gauges():
    from tidelog.operators.metrics import gauges

    got = gauges({"batchId": 3, "inputRowsPerSecond": 2.0}, {"a": 5, "b": 9}, head=10, budget=100, used=7)
    assert got["lag"] == 5 and got["active_consumers"] == 2 and got["batch"] == 3 and got["memory_used"] == 7


def test_service(spark, tmp_path):
    from tidelog.errors import ConfigInvalid, OffsetRegression
    from tidelog.operators import crypto
    from tidelog.plans.publication import PublishedTable
    from tidelog.plans.service import Service
    from tidelog.plans.subscription import Subscription

    key = F.lit("test-only-key-16").cast("binary")
    rows = [(k, 1, "insert" if k % 2 else "delete", ("public", f"t{k % 3}"), "0" * 16, [("a", 0, str(k))], None, 0) for k in range(1, 400)]
    log.append(crypto.encrypt(spark.createDataFrame(rows, CHANGE_SCHEMA), ["a"], key), f"file://{tmp_path}/log", "acme", span=100)
    own = Service(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/offsets", "acme", 100)
    wanted = Subscription("c", ("public.t1",), ("insert",), encrypted=("a",), credits=5)
    own.register("c", key)
    assert own.status("c") == {"consumer": "c", "registered": True, "committed": None, "head": 399, "lag": 399} and own.watermark() == 0 == own.collect_garbage()
    got = own.subscribe(wanted).collect()
    assert [r.lsn for r in got] == [1, 7, 13, 19, 25] and [r.after[0].value for r in got] == ["1", "7", "13", "19", "25"]
    own.commit_offset("c", 25)
    assert [r.lsn for r in own.subscribe(wanted).collect()] == [31, 37, 43, 49, 55]
    for lsn, error in ((24, OffsetRegression), (400, ConfigInvalid)):
        with pytest.raises(error):
            own.commit_offset("c", lsn)
    own.commit_offset("c", 250)
    own.register("d")
    assert own.watermark() == 0 and own.consumers() == [{"consumer": "c", "committed": 250, "lag": 149}, {"consumer": "d", "committed": None, "lag": 399}]
    own.unregister("d")
    assert own.watermark() == 250 and own.collect_garbage() == 2 and own.events().agg(F.min("lsn")).first()[0] == 200
    assert own.reload({"public.t1": "op:delete", "public.t2": "a == 1"}) == ["public.t1", "public.t2"] and own.reload({"public.t1": "op:delete"}) == ["public.t2"]
    assert own.subscribe(wanted).count() == 0
    assert own.publication_diff([PublishedTable("a.b"), PublishedTable("a.c", where="x")], [PublishedTable("a.c"), PublishedTable("a.d")]) == {"a.b": "add", "a.c": "alter", "a.d": "drop"}
    seen = []
    for k, state in enumerate(own.watch(wait=lambda s: own.drain() if not seen[1:] and own.lifecycle.state == "running" else own.stop())):
        seen.append(state)
    assert seen == ["serving", "not serving"] and own.health() == "not serving"


def test_lsn_format_where_the_halves_overflow(spark, tmp_path):
    import duckdb

    from tidelog import queries

    overflow = [k for k in range(65_000, 400_000) if k * 1_000_003 % 65536 * 65536 + k >= 1 << 32]
    ids = [None, 0, 1, 65_535, 65_536, *overflow[:5], 1 << 28, 9_007_199_255, 9_000_000_000_001, -1, -65_537]
    spark.createDataFrame([(k,) for k in ids], "event_id long").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["lsn_format"]).fetchall()
    assert overflow and dict(map(tuple, queries.queries()["lsn_format"](spark, f"file://{tmp_path}").collect())) == dict(want)

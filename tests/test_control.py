"""Control models with clocks as arguments, and scalar cases."""

import pytest

from tidelog.errors import ConfigInvalid, MalformedLsn, OffsetRegression, SlotMissing
from tidelog.functions import hashing, lsn
from tidelog.operators import control as c
from tidelog.operators import delivery, metrics
from tidelog.operators.offsets import FileOffsetStore
from tidelog.sources import config


def test_lsn():
    assert lsn.parse_text("0/16B3740") == 23803712 and lsn.format_text(23803712) == "0/16B3740"
    for bad in ("", "16B3740", "x/1", "1/", "123456789/0"):
        with pytest.raises(MalformedLsn):
            lsn.parse_text(bad)


def test_ring_flush_coordinator():
    ring = c.RingBuffer(2)
    assert ring.try_push(("a", 10)) and ring.try_push(("b", 5)) and not ring.try_push(("c", 1)) and ring.fill_ratio == 1
    own = c.Coordinator(ring, c.FlushPolicy(100, 50))
    assert own.poll(10) is None and own.poll(50) == ["a", "b"] and own.flush(60) is None and own.events_processed == 2
    ring.try_push(("d", 100))
    assert own.poll(51) == ["d"] and own.batches_flushed == 2
    assert not c.FlushPolicy(10, 5).due(0, 100)
    with pytest.raises(ConfigInvalid):
        c.RingBuffer(0)


def test_credits_pending_gate():
    credits = c.Credits(2)
    assert credits.consume() and credits.consume() and not credits.consume()
    credits.replenish(10)
    credits.replenish(1)
    assert credits.left == 3  # above the window
    credits.reset()
    assert credits.left == 2
    cap = c.PendingCap(1)
    cap.sent()
    assert cap.paused
    cap.acknowledged(5)
    assert cap.pending == 0
    gate = c.Gate()
    gate.close("lag")
    assert not gate.is_open and gate.closings == 1
    gate.open()
    assert gate.is_open


def test_bucket_ack_memory_lag():
    bucket = c.TokenBucket(2, 2)
    assert bucket.acquire(0) and bucket.acquire(0) and not bucket.acquire(0) and bucket.wait() == 0.5
    assert bucket.acquire(0.5) and c.TokenBucket(0, 0).acquire(0)
    ack = c.AckPolicy(1, 10)
    ack.advance(5, 3)
    assert ack.report(0.5) is None and ack.report(1) == (5, 3, 3) and ack.report(5) is None and ack.report(11) == (5, 3, 3)
    ack.advance(1, 1)
    assert not ack.dirty
    memory = c.MemoryBudget(100, 1.5)
    memory.allocate(120)
    assert memory.exceeded and memory.warning and memory.remaining == 0 and memory.warn_ratio == 1
    memory.release(500)
    assert memory.used == 0
    lag = c.LagPolicy(10)
    assert [lag.observe(x) for x in (10, 11, 6, 5, 4, 10)] == [False, True, True, True, False, False]


def test_breaker_retry_dead_letters():
    b = c.CircuitBreaker(2, 100)
    for t in (1, 2):
        assert b.allow(t)
        b.report(False, t)
    assert b.state == "open" and not b.allow(50)
    b.report(True, 60)
    assert b.state == "open" and b.failures == 0
    assert b.allow(102) and b.state == "half_open" and not b.allow(103)
    b.report(False, 104)
    assert b.state == "open" and b.allow(204)
    b.report(True, 205)
    assert b.state == "closed" and b.allow(206)
    r = c.RetryPolicy(3, 100)
    assert [r.backoff(k) for k in range(4)] == [100, 200, 400, 800] and c.RetryPolicy(3, 1000, 30_000).backoff(10) == 30_000
    assert r.again(1) and not r.again(2)
    d = c.DeadLetters(2)
    for k in range(3):
        d.push(k, "e", 1, 0)
    assert d.total == 3 and [x[0] for x in d.drain()] == [1, 2] and d.drain() == []
    m = c.MicroBatcher(2)
    assert not m.push(1) and m.push(2) and m.drain() == [1, 2] and m.drain() == []


def test_wal(tmp_path):
    w = c.WalWriter(tmp_path, 30)
    for k in range(8):
        w.append(k, b"payload")
    w.sync()
    w.close()
    files = sorted(tmp_path.glob("*.log"))
    assert files[0].name == "wal_00000000.log" and c.read_wal(files[0]) == [(0, b"payload"), (1, b"payload")]
    assert w.segment == 3 and w.collect(watermark=1) == [] and w.collect() == [0]
    again = c.WalWriter(tmp_path, 30)
    assert again.segment == 4
    again.close()


def test_slots_lifecycle():
    s = c.SlotManager()
    with pytest.raises(SlotMissing):
        s.ensure("a", 5, False)
    assert s.ensure("a", 5, True) == 5 and s.ensure("a", 9, True) is None
    s.drop("a")
    assert s.ensure("a", 9, True) == 9
    life = c.Lifecycle()
    life.to("running")
    assert life.ready and life.live
    with pytest.raises(ConfigInvalid):
        life.to("starting")
    assert delivery.health(life.ready, life.live) == '{"ready":true,"live":true}'


def test_offset_store(spark, tmp_path):
    store = FileOffsetStore(spark, f"file://{tmp_path}/offsets")
    assert store.resume("a") == 0
    store.commit("a", 5)
    store.commit("a", 5)
    with pytest.raises(OffsetRegression):
        store.commit("a", 4)
    assert FileOffsetStore(spark, f"file://{tmp_path}/offsets").resume("a") == 6
    store.unregister("a")
    assert store.load() == {}


def test_config(tmp_path):
    (tmp_path / "default.toml").write_text('[pipeline]\nflush_bytes = 5\n[pipeline.filters]\n"public.t" = "op:insert"\n[unknown]\nx = 1\n')
    (tmp_path / "production.toml").write_text("[pipeline]\nring_capacity = 7\n")
    got = config.load(tmp_path, "production", {"TIDELOG_PIPELINE__FLUSH_BYTES": "9", "OTHER": "1"})
    assert (got.pipeline.flush_bytes, got.pipeline.ring_capacity, got.memory.warn_ratio) == (9, 7, 0.8)
    assert got.pipeline.filters == {"public.t": "op:insert"}
    with pytest.raises(ConfigInvalid):
        config.load(tmp_path, "x", {"TIDELOG_PIPELINE__FLUSH_BYTES": "many"})
    with pytest.raises(ConfigInvalid):
        config.load(tmp_path / "nowhere")
    assert config.parquet_codec("none") == "uncompressed" and config.parquet_codec("?") == "lz4_raw"


def test_hash_and_signature():
    assert hashing.fnv1a(b"public") == 0xF4B72165F60F5B60
    a = hashing.fingerprint("public", "users", [("id", "int4"), ("name", "text")])
    assert a == hashing.fingerprint("public", "users", [("id", "int4"), ("name", "text")]) != hashing.fingerprint("public", "users", [("id", "int8"), ("name", "text")])
    assert hashing.signature("k", b"x").startswith("sha256=") and len(hashing.signature("k", b"x")) == 71
    assert hashing.signature("k", b"x", compat=True) == f"sha256={hashing.fnv1a(b'kx'):x}"
    headers = delivery.request_headers("[]", 0, "k", "e1")
    assert headers["X-Tidelog-Events"] == "0" and headers["X-Event-ID"] == "e1"


def test_prometheus():
    assert metrics.prometheus({"a": 1}, {"b": [({"c": 'x"y'}, 2.5)]}) == 'tidelog_a 1\ntidelog_b{c="x\\"y"} 2.5\n'

"""Replication frames, DDL messages and the event codec."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from tidelog.errors import MalformedPayload
from tidelog.operators import codec
from tidelog.schema import CHANGE_SCHEMA
from tidelog.sources import ddl
from tidelog.sources import frames as f


def captured(spark, data):
    return spark.createDataFrame([(k, 100 + k, bytearray(d)) for k, d in enumerate(data)], f.FRAME_SCHEMA)


STREAM = [
    f.begin_frame(900, 1_700_000_000_000_123, 42),
    f.relation_frame(5, "public", "orders", [("id", 23), ("note", 25)]),
    f.insert_frame(5, ["1", None]),
    f.update_frame(5, ["1", "x"], ["1", None]),
    f.update_frame(5, ["1", ...]),
    f.relation_frame(5, "public", "orders", [("id", 23), ("note", 25), ("raw", 17)]),
    f.insert_frame(5, ["2", "é", b"\x01\xff", "more"]),
    f.delete_frame(5, ["1", None]),
    f.relation_frame(6, "public", "lines", [("id", 23)]),
    f.truncate_frame([5, 6, 99]),
    f.commit_frame(900),
    b"", b"Yx", b"O", f.message_frame(7, "ddl", "ADD_COLUMN|public.t|ALTER TABLE t ADD COLUMN c int"),
    f.insert_frame(77, ["1"]),
    f.insert_frame(5, ["1"])[:9],
    f.begin_frame(901, 1_700_000_000_000_456, 43),
    f.insert_frame(6, ["9"]),
]


def test_decode(spark):
    got = {r.seq: r for r in f.decode(captured(spark, STREAM)).where("op <> 'truncate'").collect()}
    assert set(got) == {2, 3, 4, 6, 7, 18}
    assert [(c.name, c.type_oid, c.value) for c in got[2].after] == [("id", 23, "1"), ("note", 25, None)]
    assert got[2].before is None and got[2].xid == 42 and got[2].commit_timestamp_us == 1_700_000_000_000_123
    assert got[3].before[0].value == "1" and got[4].before is None and got[4].toast_unchanged == ["note"]
    assert [(c.name, c.type_oid, c.value) for c in got[6].after] == [("id", 23, "2"), ("note", 25, "é"), ("raw", 17, "\\x01ff"), ("col_3", 0, "more")]
    assert got[6].schema_fingerprint != got[2].schema_fingerprint
    assert got[7].after is None and got[7].before[0].value == "1" and got[18].xid == 43
    cut = f.decode(captured(spark, STREAM)).where("op = 'truncate'").collect()
    assert sorted(r.table.table for r in cut) == ["lines", "orders"] and all(r.after is None and r.before is None for r in cut)
    first = f.decode(captured(spark, STREAM), truncate_first_only=True, transactions=False).where("op = 'truncate'").collect()
    assert [(r.table.table, r.xid) for r in first] == [("orders", 0)]


def test_like_a_reader(spark, monkeypatch):
    """Random captures of two segments against one reader that goes through them in order, with small chunks."""
    import random

    monkeypatch.setattr(f, "CHUNK", 5)
    rng, rows, want = random.Random(4), [], {}
    for segment in range(2):
        state, names = {}, "abcé"
        for seq in range(160):
            oid = rng.randint(1, 4)
            values = [rng.choice([None, ..., "", "x", "é日", b"\x00\xff", "long" * 9]) for _ in range(rng.randint(0, 5))]
            kind = "BRIIIIUUDDTCM!"[rng.randrange(14)]
            if kind == "B":
                state["xid"] = seq
                data = f.begin_frame(seq, 1_700_000_000_000_000 + seq, seq)
            elif kind == "R":
                state[oid] = [(f"{names[k]}{seq}", k) for k in range(rng.randint(0, 4))]
                data = f.relation_frame(oid, "s", f"t{oid}", state[oid])
            elif kind in "IUD":
                data = f.insert_frame(oid, values) if kind == "I" else f.delete_frame(oid, values) if kind == "D" else f.update_frame(oid, values, rng.choice([None, values[:2]]), rng.choice([b"K", b"O"]))
                if oid in state:
                    shown = ["\\x" + v.hex() if isinstance(v, bytes) else None if v is ... else v for v in values]
                    cells = [(state[oid][k][0] if k < len(state[oid]) else f"col_{k}", v) for k, v in enumerate(shown)]
                    want[segment, seq] = (f"t{oid}", state.get("xid", 0), cells if kind != "D" else None, cells if kind == "D" else None)
            elif kind == "!":
                data = rng.choice([f.insert_frame(oid, ["abcdef"])[:-3], f.insert_frame(oid, ["ok"]).replace(b"ok", b"\xff\xfe"), b"U", f.update_frame(oid, ["a"], ["b"])[:-4]])
            else:
                data = f.truncate_frame([9]) if kind == "T" else f.commit_frame(seq) if kind == "C" else f.message_frame(seq, "x", "y")
            rows.append((seq, seq, bytearray(data), segment))
    df = spark.createDataFrame(rows, "seq long, lsn long, data binary, segment long").repartition(3)
    for segment in range(2):
        got = {}
        for r in f.decode(df.where(f"segment = {segment}")).collect():
            before = r.before if r.op == "delete" else None
            got[segment, r.seq] = (r.table.table, r.xid, r.after and [(c.name, c.value) for c in r.after], before and [(c.name, c.value) for c in before])
        assert {k: (t, x, a or None, b or None) for k, (t, x, a, b) in got.items()} == {k: (t, x, a or None, b or None) for k, (t, x, a, b) in want.items() if k[0] == segment}
    assert f.decode(df).count() == len(want)
    bad = {(r.seq, r.error) for r in f.errors(df).collect()}
    assert sum("unknown relation" not in e for _, e in bad) == sum(d[0] == ord("U") and len(d) == 1 or _damaged(bytes(d)) for _, _, d, _ in rows)


def _damaged(data):
    try:
        f.parse(data)
    except (MalformedPayload, UnicodeDecodeError):
        return len(data) > 1
    return False


def test_errors_and_strict(spark):
    bad = {r.seq: r.error for r in f.errors(captured(spark, STREAM)).collect()}
    assert set(bad) == {15, 16} and "unknown relation 77" in bad[15] and "offset" in bad[16]
    assert f.last_processed(captured(spark, STREAM)).first()[0] == 118
    with pytest.raises(PySparkException):
        f.decode(captured(spark, STREAM), strict=True).collect()
    assert [r.content for r in f.ddl_frames(captured(spark, STREAM)).collect()] == ["ADD_COLUMN|public.t|ALTER TABLE t ADD COLUMN c int"]
    for data in (b"B" + bytes(19), b"C" + bytes(24), b"I" + bytes(4) + b"K\0\0", b"R" + bytes(4) + b"public"):
        with pytest.raises(MalformedPayload):
            f.parse(data)
    assert f.parse(b"I\0\0\0\1N\0\1?")["new"] == [{"value": None, "unchanged": False}]  # an unknown tag
    assert f.parse(f.relation_frame(1, "s", "t", [], "x"))["identity"] == "d"


def test_carried_forward(spark):
    events = f.decode(captured(spark, STREAM)).where("seq in (2, 3, 4)")
    got = {r.seq: r for r in f.carried_forward(events, "id").collect()}
    assert [c.value for c in got[4].after] == ["1", "x"] and [c.value for c in got[2].after] == ["1", None]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    keyed = [f.begin_frame(1, 1_700_000_000_000_000, 1), STREAM[1], *(f.insert_frame(5, [str(k), f"v{k}"]) for k in range(40)), *(f.update_frame(5, [str(k), ...]) for k in range(40))]
    filled = f.carried_forward(f.decode(captured(spark, keyed)).repartition(5, "lsn"), "id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(filled) == 80 and all(r.after[1].value == f"v{r.after[0].value}" for r in filled)


def test_ddl(spark):
    rows = [(1, "ALTER_TABLE|public.orders|ALTER TABLE public.orders ADD COLUMN status text"), (2, "ADD_COLUMN|public.users|ALTER TABLE public.users ADD COLUMN email text"), (3, "RENAME_TABLE|a.b|ALTER TABLE a.b RENAME TO c;"), (4, "DROP_COLUMN|a.b|ALTER TABLE a.b"), (5, "two|parts"), (6, None), (7, "DROP_TABLE|a.b|x|y")]
    got = {r.lsn: r for r in ddl.parse(spark.createDataFrame(rows, "lsn long, content string")).collect()}
    assert got[1].kind == "AlterTable" and got[1].detail is None and got[1].table == "public.orders"
    assert got[2].detail == "email" and got[3].detail == "c" and got[4].detail == "" and got[7].statement == "x|y"
    assert set(got) == {1, 2, 3, 4, 7}
    assert ddl.capture_drop("a.b") == "DROP_TABLE|a.b|DROP TABLE" and ddl.parse_one(ddl.capture("ALTER TABLE", "a.b", "s"))[0] == "ALTER_TABLE"
    with pytest.raises(MalformedPayload):
        ddl.parse_one("x")


def test_codec_known_event(spark):
    event = (123456, 42, "insert", ("public", "orders"), "00000000deadbeef", [("id", 23, "1"), ("status", 25, "pending")], None, 1_700_000_000_000_000)
    empty = (1, 2, "truncate", ("s", "é"), "f" * 16, None, [], 0)
    rows = spark.createDataFrame([event, empty], CHANGE_SCHEMA)
    back = {r.lsn: r for r in codec.decode(codec.stored(rows)).collect()}
    assert tuple(back[123456].after[1]) == ("status", 25, "pending") and back[123456].schema_fingerprint == "00000000deadbeef" and back[123456].before is None
    assert back[1].before == [] and back[1].after is None and back[1].table.table == "é" and back[1].op == "truncate"


texts = st.text(max_size=12)
row_values = st.one_of(st.none(), st.lists(st.tuples(texts, st.integers(0, 2**32 - 1), st.one_of(st.none(), texts)), max_size=4))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**62), st.integers(0, 2**32 - 1), st.sampled_from(["insert", "update", "delete", "truncate"]), row_values, row_values), min_size=1, max_size=20))
def test_codec_round_trip(spark, rows):
    data = [(lsn, k, op, ("s", "t"), "0" * 16, a, b, 5) for k, (lsn, _, op, a, b) in enumerate(rows)]
    back = {r.xid: r for r in codec.decode(codec.stored(spark.createDataFrame(data, CHANGE_SCHEMA)), strict=True).collect()}
    for lsn, k, op, _, _, a, b, _ in data:
        r = back[k]
        assert (r.lsn, r.op) == (lsn, op)
        for have, want in ((r.after, a), (r.before, b)):
            assert (have is None) == (want is None) and (want is None or [tuple(c) for c in have] == want)


def test_codec_like_one_by_one(spark):
    """Whole payloads, and such with a byte cut off, added or changed, against the reader of one payload."""
    import random

    import pyarrow as pa

    rng = random.Random(2)
    cell = lambda: (rng.choice(["", "a", "é"]), rng.randint(0, 2**32 - 1), rng.choice([None, "", "日本", "x" * 300]))
    image = lambda: rng.choice([None, [], [cell() for _ in range(rng.randint(1, 4))]])
    rows = [(rng.randint(0, 2**62), rng.randint(0, 2**32 - 1), rng.choice(["insert", "update", "delete", "truncate"]), ("s", "té"), f"{rng.getrandbits(64):016x}", image(), image(), rng.randint(-5, 2**60)) for _ in range(40)]
    whole = [bytes(r.payload) for r in codec.stored(spark.createDataFrame(rows, CHANGE_SCHEMA)).select("payload").collect()]
    data = [*whole, None, b""]
    for x in whole:
        k = rng.randrange(len(x))
        data += [x[:k], x + b"z", x[:k] + bytes([rng.randrange(256)]) + x[k + 1 :], x.replace("日".encode(), b"\xe6\x97\xe6")]
    want, bad = [], []
    for k, x in enumerate(data):
        try:
            want.append(codec.decode_one(x or b""))
        except (MalformedPayload, UnicodeDecodeError):
            bad.append(k)
        else:
            if want[-1]["lsn"] >= 2**63:
                want.pop()
                bad.append(k)
    events, left = codec.decoded(pa.array(data, pa.binary()))
    assert left.tolist() == bad and events.to_pylist() == want


def test_codec_damage(spark):
    with pytest.raises(MalformedPayload):
        codec.decode_one(b"\0" * 10)
    with pytest.raises(MalformedPayload):
        codec.decode_one(bytes(12) + b"X" + bytes(30))
    df = spark.createDataFrame([(bytearray(b"\0"),)], "payload binary")
    assert codec.decode(df).count() == 0

"""Captured logical-replication frames: wire reading, as-of relations, transactions, change events.

A frame is (seq, lsn, data). Changes are cut into fields for all frames of an Arrow batch at once, by numpy over their
bytes; the few other frames, and those that are damaged, one by one. Frames that are no change give no row. A damaged
frame fails the query in strict mode, else it becomes a row of ``errors``.

Which relation a change belongs to, and which transaction, is what came last before it. Frames are looked at in chunks
of ``CHUNK`` places: inside a chunk by a window, and what a chunk starts with by a walk over the chunks, a small row for
each. So the changes of one captured stream are as many tasks as it has chunks, and they are shuffled once. Several captured segments may be decoded together, with
``segment`` to tell them apart; a segment starts with a transaction and repeats the relations that it uses, as a
replication connection does.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import MalformedPayload
from tidelog.functions.hashing import fingerprint, fingerprint_column
from tidelog.functions.wire import binary_buffer, damaged_texts, gathered, number_at, texts
from tidelog.operators.folds import fold
from tidelog.schema import ROW_TYPE

#: Microseconds from 1970-01-01 to 2000-01-01, where the protocol's clock starts.
EPOCH_US = 946_684_800_000_000

#: Places of frames in a chunk.
CHUNK = 4_096
_COLUMN = pa.struct([("name", pa.string()), ("type_oid", pa.int64()), ("is_key", pa.bool_())])
_VALUE = pa.struct([("value", pa.string()), ("unchanged", pa.bool_())])
PARSED = pa.schema(
    [
        ("segment", pa.int64()), ("seq", pa.int64()), ("lsn", pa.int64()), ("kind", pa.string()), ("rel_id", pa.int64()),
        ("rel_schema", pa.string()), ("rel_table", pa.string()), ("identity", pa.string()), ("columns", pa.list_(_COLUMN)),
        ("xid", pa.int64()), ("ts_us", pa.int64()), ("final_lsn", pa.int64()), ("new", pa.list_(_VALUE)), ("old", pa.list_(_VALUE)),
        ("rel_ids", pa.list_(pa.int64())), ("content", pa.string()), ("error", pa.string()),
    ]
)
_SPARK_PARSED = (
    "segment long, seq long, lsn long, kind string, rel_id long, rel_schema string, rel_table string, identity string, "
    "columns array<struct<name:string,type_oid:long,is_key:boolean>>, xid long, ts_us long, final_lsn long, "
    "new array<struct<value:string,unchanged:boolean>>, old array<struct<value:string,unchanged:boolean>>, "
    "rel_ids array<long>, content string, error string"
)


class Reader:
    """Big-endian fields of a frame; a read beyond its end says where."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise MalformedPayload(f"{n} bytes wanted at offset {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(">" + kind, self.take(struct.calcsize(">" + kind)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise MalformedPayload(f"a string at offset {self.at} has no end")
        found = self.take(end - self.at)
        self.at += 1
        return found.decode("utf-8")

    def row(self) -> list[dict]:
        """The values of a row; what is unchanged and was not sent is null and marked."""
        out = []
        for _ in range(self.number("H")):
            tag = self.take(1)
            value = None
            if tag in (b"t", b"b"):
                data = self.take(self.number("I"))
                value = data.decode("utf-8") if tag == b"t" else "\\x" + data.hex()
            out.append({"value": value, "unchanged": tag == b"u"})  # an unknown tag is a null
        return out


def parse(data: bytes) -> dict:
    """The fields of one frame; a dict without ``kind`` for a frame to ignore."""
    if not data:
        return {}
    kind, r = chr(data[0]), Reader(data)
    r.at = 1
    if kind == "B":
        final_lsn, ts, xid = r.number("q"), r.number("q"), r.number("I")
        return {"kind": kind, "final_lsn": final_lsn, "ts_us": ts + EPOCH_US, "xid": xid}
    if kind == "C":
        r.take(1)
        lsn = r.number("q")
        r.take(16)
        return {"kind": kind, "final_lsn": lsn}
    if kind == "R":
        found = {"kind": kind, "rel_id": r.number("I"), "rel_schema": r.text(), "rel_table": r.text()}
        identity = r.take(1).decode("latin-1")
        columns = []
        for _ in range(r.number("H")):
            flags, name, oid = r.number("B"), r.text(), r.number("I")
            r.take(4)
            columns.append({"name": name, "type_oid": oid, "is_key": bool(flags & 1)})
        return found | {"identity": identity if identity in "dnfi" else "d", "columns": columns}
    if kind == "I":
        found = {"kind": kind, "rel_id": r.number("I")}
        if r.take(1) != b"N":
            raise MalformedPayload("an insert has no new row")
        return found | {"new": r.row()}
    if kind == "U":
        found, tag = {"kind": kind, "rel_id": r.number("I")}, r.take(1)
        if tag in (b"K", b"O"):
            found["old"] = r.row()
            r.take(1)
        return found | {"new": r.row()}
    if kind == "D":
        found = {"kind": kind, "rel_id": r.number("I")}
        r.take(1)
        return found | {"old": r.row()}
    if kind == "T":
        n = r.number("I")
        r.take(1)
        return {"kind": kind, "rel_ids": [r.number("I") for _ in range(n)]}
    if kind == "M":
        r.take(1)
        lsn, prefix = r.number("q"), r.text()
        return {"kind": kind, "final_lsn": lsn, "identity": prefix, "content": r.take(r.number("I")).decode("utf-8")}
    return {}


def parsed(frames: DataFrame) -> DataFrame:
    """Frames (seq, lsn, data and, if there, segment) with their fields; frames to ignore are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = changes_of(batch.column(3))
            if len(done.rows):
                yield _changes_batch(batch, done)
            rest = np.ones(batch.num_rows, bool)
            rest[done.rows] = False
            out = []
            for r in batch.filter(pa.array(rest)).to_pylist():
                head = {"segment": r["segment"], "seq": r["seq"], "lsn": r["lsn"]}
                try:
                    fields = parse(r["data"] or b"")
                except (MalformedPayload, UnicodeDecodeError) as e:
                    fields = {"kind": "!", "error": str(e)}
                if fields:
                    out.append(head | fields)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=PARSED)

    return _with_segment(frames).select("segment", "seq", "lsn", "data").mapInArrow(run, _SPARK_PARSED)


def _with_segment(frames: DataFrame) -> DataFrame:
    return frames if "segment" in frames.columns else frames.withColumn("segment", F.lit(0).cast("long"))


@dataclass
class Changes:
    """Frames of a batch that are whole inserts, updates and deletes: their rows in the batch, kinds and relations, and
    for the new and the old row of each how many values it has (-1: no such row), then all values' tags and bytes."""

    rows: np.ndarray
    kind: np.ndarray
    rel_id: np.ndarray
    images: dict[str, tuple]


def _walk(buf: np.ndarray, at: np.ndarray, end: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Read the rows that begin at ``at`` for the frames that are ``live``, a column of all frames at a time.

    Returns where each row ends (beyond the frame if it is cut off) and (number of values, frame, tag, first byte, size).
    """
    at, end = at.copy(), np.where(live, end, 0)
    ok = live & (at + 2 <= end)
    count = np.full(len(at), -1, np.int64)
    count[ok] = number_at(buf, at[ok], 2)
    at = np.where(ok, at + 2, np.where(live, end + 1, at))
    owners, tags, firsts, sizes = [], [], [], []
    k = 0
    now = np.flatnonzero(ok & (count > 0))
    while len(now):
        now = now[at[now] < end[now]]
        tag, size, first = buf[at[now]], np.zeros(len(now), np.int64), at[now] + 1
        sent = (tag == ord("t")) | (tag == ord("b"))
        whole = sent & (first + 4 <= end[now])
        size[whole] = number_at(buf, first[whole], 4)
        first = first + 4 * sent
        owners.append(now)
        tags.append(tag)
        firsts.append(first)
        sizes.append(size)
        at[now] = np.where(sent & ~whole, end[now] + 1, first + size)
        k += 1
        now = now[(at[now] <= end[now]) & (count[now] > k)]
    short = np.flatnonzero(ok & (count > k))  # none is left unread but those that are cut off
    at[short] = np.maximum(at[short], end[short] + 1)
    none = np.zeros(0, np.int64)
    owner, tag, first, size = (np.concatenate([none, *x]) for x in (owners, tags, firsts, sizes))
    read = np.bincount(owner, minlength=len(at))
    at[ok & (read < count)] = end[ok & (read < count)] + 1
    order = np.argsort(owner, kind="stable")
    return at, (count, owner[order], tag[order], first[order], size[order])


def changes_of(data: pa.Array) -> Changes:
    """What of a batch of frames are whole changes; all else is left to ``parse``."""
    buf, begin, end = binary_buffer(data)
    there = data.is_valid().to_numpy(zero_copy_only=False)
    kind = np.zeros(len(data), np.uint8)
    long = there & (end - begin >= 6)
    kind[long] = buf[begin[long]]
    rows = np.flatnonzero(np.isin(kind, list(b"IUD")))
    kind, begin, end = kind[rows], begin[rows], end[rows]
    rel_id, tag, at = number_at(buf, begin + 1, 4), buf[begin + 5], begin + 6
    good = (kind != ord("I")) | (tag == ord("N"))
    has_old = (kind == ord("D")) | ((kind == ord("U")) & ((tag == ord("K")) | (tag == ord("O"))))
    at, old = _walk(buf, at, end, good & has_old)
    at = at + (has_old & (kind == ord("U")))  # the new row's own tag
    has_new = kind != ord("D")
    at, new = _walk(buf, at, end, good & has_new)
    good &= at <= end
    good &= _valid_text(buf, (new, old), len(rows))
    picked = np.flatnonzero(good)
    place = np.full(len(rows), -1)
    place[picked] = np.arange(len(picked))
    images = {}
    for name, (count, owner, tags, first, size) in (("new", new), ("old", old)):
        own = good[owner]
        images[name] = (count[picked], tags[own], first[own], size[own], buf)
    return Changes(rows[picked], kind[picked], rel_id[picked], images)


def _valid_text(buf: np.ndarray, images: tuple, n: int) -> np.ndarray:
    """Whether all texts of each frame are UTF-8."""
    good = np.ones(n, bool)
    for _, owner, tags, first, size in images:
        fits = first + size <= len(buf)
        good[owner[~fits]] = False
        text = np.flatnonzero((tags == ord("t")) & (size > 0) & fits)
        good[owner[text[damaged_texts(buf, first[text], size[text])]]] = False
    return good


def _values(count: np.ndarray, tags: np.ndarray, first: np.ndarray, size: np.ndarray, buf: np.ndarray) -> pa.Array:
    """The list column of one image: texts as they are, bytes as hex digits behind ``\\x``."""
    sent = (tags == ord("t")) | (tags == ord("b"))
    size = np.where(sent, size, 0)
    flat, ends = gathered(buf, first, size), np.cumsum(size)
    binary = np.flatnonzero(tags == ord("b"))
    if len(binary):
        parts, at = [], 0
        for k in binary.tolist():
            parts += [flat[at : ends[k] - size[k]].tobytes(), b"\\x" + flat[ends[k] - size[k] : ends[k]].tobytes().hex().encode()]
            at = ends[k]
        flat = np.frombuffer(b"".join([*parts, flat[at:].tobytes()]), np.uint8)
        size[binary] = 2 + 2 * size[binary]
    values = pa.StructArray.from_arrays([texts(flat, size, sent), pa.array(tags == ord("u"))], fields=list(_VALUE))
    lists = np.concatenate(([0], np.cumsum(np.maximum(count, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), values, mask=pa.array(count < 0))


def _changes_batch(batch: pa.RecordBatch, done: Changes) -> pa.RecordBatch:
    n, picked = len(done.rows), pa.array(done.rows)
    letters = pa.DictionaryArray.from_arrays(pa.array(np.searchsorted([68, 73, 85], done.kind)), pa.array(["D", "I", "U"])).cast(pa.string())
    found = {f.name: batch.column(k).take(picked) for k, f in enumerate(batch.schema) if f.name != "data"}
    found |= {"kind": letters, "rel_id": pa.array(done.rel_id), "new": _values(*done.images["new"]), "old": _values(*done.images["old"])}
    return pa.RecordBatch.from_arrays([found[f.name].cast(f.type) if f.name in found else pa.nulls(n, f.type) for f in PARSED], schema=PARSED)


def _relation() -> F.Column:
    kinds = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["type_oid"].cast("string").alias("type_name")))
    print_ = fingerprint_column(F.col("rel_schema"), F.col("rel_table"), kinds).alias("fingerprint")  # once for each relation
    return F.when(F.col("kind") == "R", F.struct("rel_schema", "rel_table", "identity", "columns", print_))


def _begin() -> F.Column:
    return F.when(F.col("kind") == "B", F.struct("xid", "ts_us", "final_lsn"))


def _chunk() -> F.Column:
    return F.floor(F.col("seq") / CHUNK).alias("chunk")


_BEGIN = "struct<xid:long,ts_us:long,final_lsn:long>"
_RELATION = "struct<rel_schema:string,rel_table:string,identity:string,columns:array<struct<name:string,type_oid:long,is_key:boolean>>,fingerprint:string>"


def starts(frames: DataFrame) -> DataFrame:
    """(segment_, chunk_, begin_, relations_): the transaction and the relations that a chunk starts with.

    A chunk becomes one row with the relations that it changes and its few frames of other kinds; a segment's rows are
    then gone through in order, which is a step for every ``CHUNK`` frames.
    """
    kind = F.substring("data", 1, 1)
    rel_id = F.conv(F.hex(F.substring("data", 2, 4)), 16, 10).cast("long")
    used = F.collect_set(F.when(kind.isin(*[F.lit(x) for x in (b"I", b"U", b"D")]), rel_id)).alias("used")
    rare = F.sort_array(F.collect_list(F.when(kind.isin(*[F.lit(x) for x in (b"B", b"R", b"T")]), F.struct("seq", "data")))).alias("rare")
    chunks = _with_segment(frames).groupBy("segment", _chunk()).agg(used, rare)

    def step(state: dict, row: dict) -> tuple:
        wanted, told = set(row["used"]), []
        for frame in row["rare"]:
            try:
                told.append(parse(frame["data"]))
            except (MalformedPayload, UnicodeDecodeError):  # the frame's own row has the error
                continue
            wanted.update(told[-1].get("rel_ids", ()))
        begin, relations = state.get("begin"), [{"rel_id": k, "relation": state[k]} for k in sorted(wanted) if k in state]
        for fields in told:
            if fields["kind"] == "B":
                state["begin"] = {k: fields[k] for k in ("xid", "ts_us", "final_lsn")}
            elif fields["kind"] == "R":
                print_ = fingerprint(fields["rel_schema"], fields["rel_table"], [(c["name"], str(c["type_oid"])) for c in fields["columns"]])
                state[fields["rel_id"]] = {k: fields[k] for k in ("rel_schema", "rel_table", "identity", "columns")} | {"fingerprint": print_}
        return begin, relations

    found = fold(chunks, ["segment"], "chunk", dict, step, f"begin {_BEGIN}, relations array<struct<rel_id:long,relation:{_RELATION}>>")
    return found.select(*[F.col(c).alias(c + "_") for c in ("segment", "chunk", "begin", "relations")])


def with_relations(frames: DataFrame, truncate_first_only: bool = False) -> DataFrame:
    """The parsed frames with the latest preceding relation of their id, and the transaction that they are in.

    A truncate is a row for each of its relations, or for the first (as older readers had it).
    """
    many = F.slice("rel_ids", F.lit(1), F.lit(1)) if truncate_first_only else F.col("rel_ids")
    each = parsed(frames).withColumn("rel_id", F.explode_outer(F.when(F.col("kind") == "T", many).otherwise(F.array("rel_id"))))
    each = each.withColumn("chunk", _chunk()).repartition("segment", "chunk")
    by_relation = Window.partitionBy("segment", "chunk", "rel_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    by_chunk = Window.partitionBy("segment", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = each.withColumn("relation", F.last(_relation(), True).over(by_relation)).withColumn("begin", F.last(_begin(), True).over(by_chunk))
    first = starts(frames)
    joined = inside.join(first, (F.col("segment") == F.col("segment_")) & (F.col("chunk") == F.col("chunk_")), "left")
    told = F.try_element_at(F.filter("relations_", lambda r: r["rel_id"] == F.col("rel_id")), F.lit(1))["relation"]
    joined = joined.withColumn("relation", F.coalesce("relation", told)).withColumn("begin", F.coalesce("begin", "begin_"))
    return joined.drop("chunk", "segment_", "chunk_", "begin_", "relations_")


def _row(values: str) -> F.Column:
    """Values under the relation's names; more values than columns are named by their place."""
    known = F.col("relation.columns")
    name = lambda i: F.coalesce(F.get(known, i)["name"], F.concat(F.lit("col_"), i.cast("string")))
    made = F.transform(values, lambda v, i: F.struct(name(i).alias("name"), F.coalesce(F.get(known, i)["type_oid"], F.lit(0)).cast("long").alias("type_oid"), v["value"].alias("value")))
    return F.when(F.col(values).isNotNull(), made)


def decode(frames: DataFrame, strict: bool = False, transactions: bool = True, truncate_first_only: bool = False) -> DataFrame:
    """Change events of captured frames.

    Without ``transactions`` the transaction id and commit time stay 0. In strict mode a damaged frame and a change of
    an unknown relation fail the query; else they are left out here and ``errors`` has them.
    """
    rows = with_relations(frames, truncate_first_only).where(F.col("kind").isin("I", "U", "D", "T", "!"))
    unknown = F.col("relation").isNull() & (F.col("kind") != "T")
    if strict:
        problem = F.when(F.col("kind") == "!", F.col("error")).when(unknown, F.concat(F.lit("unknown relation "), F.col("rel_id").cast("string")))
        # one condition: a filter beside it could drop the row before it fails
        rows = rows.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(F.col("relation").isNotNull()))
    else:
        rows = rows.where(F.col("relation").isNotNull())
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("I", "insert", "U", "update", "D", "delete", "T", "truncate")]), F.col("kind"))
    zero = F.lit(0).cast("long")
    return rows.select(
        "seq", "lsn", (F.coalesce("begin.xid", zero) if transactions else zero).alias("xid"), op.alias("op"),
        F.struct(F.col("relation.rel_schema").alias("schema"), F.col("relation.rel_table").alias("table")).alias("table"),
        F.col("relation.fingerprint").alias("schema_fingerprint"),
        _row("new").cast(ROW_TYPE).alias("after"), _row("old").cast(ROW_TYPE).alias("before"),
        (F.coalesce("begin.ts_us", zero) if transactions else zero).alias("commit_timestamp_us"),
        F.transform(F.filter(F.transform("new", lambda v, i: F.struct(v["unchanged"].alias("u"), F.get("relation.columns", i)["name"].alias("n"))), lambda x: x["u"]), lambda x: x["n"]).alias("toast_unchanged"),
    )


def errors(frames: DataFrame) -> DataFrame:
    """(seq, lsn, error): damaged frames and changes of unknown relations."""
    rows = with_relations(frames).where(F.col("kind").isin("I", "U", "D", "!"))
    unknown = F.when((F.col("kind") != "!") & F.col("relation").isNull(), F.concat(F.lit("unknown relation "), F.col("rel_id").cast("string")))
    return rows.select("seq", "lsn", F.coalesce("error", unknown).alias("error")).where("error is not null")


def ddl_frames(frames: DataFrame, prefix: str = "ddl") -> DataFrame:
    """(lsn, content) of the logical messages with a prefix."""
    return parsed(frames).where((F.col("kind") == "M") & (F.col("identity") == prefix)).select("lsn", "content")


def commits(frames: DataFrame) -> DataFrame:
    """(lsn, final_lsn) of the transactions that end."""
    return parsed(frames).where("kind = 'C'").select("lsn", "final_lsn")


def last_processed(frames: DataFrame) -> DataFrame:
    """The highest LSN whose frame could be read, whatever it holds."""
    bad = errors(frames).select(F.col("seq").alias("bad"))
    return frames.join(bad, F.col("seq") == F.col("bad"), "left_anti").agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("last_processed_lsn"))


def carried_forward(events: DataFrame, key: str) -> DataFrame:
    """Fill what an update did not send (unchanged large values) from the previous row of the same key column."""
    from tidelog.schema import qualified, text

    whole = events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("row"), F.monotonically_increasing_id().alias("place"), text(F.coalesce("after", "before"), key).alias("key"))
    cells = whole.select("*", F.posexplode_outer("row.after").alias("i", "c"))  # each with its row, so nothing is joined back
    missing = F.coalesce(F.array_contains("row.toast_unchanged", F.col("c.name")), F.lit(False))
    w = Window.partitionBy(qualified(F.col("row.table")), "key", "c.name").orderBy("row.seq").rowsBetween(Window.unboundedPreceding, 0)
    sent = F.last(F.when(~missing & F.col("c").isNotNull(), F.struct(F.col("c.value").alias("value"))), True).over(w)
    cells = cells.withColumn("value", F.when(missing, sent["value"]).otherwise(F.col("c.value")))
    cell = F.when(F.col("c").isNotNull(), F.struct("i", F.struct(F.col("c.name").alias("name"), F.col("c.type_oid").alias("type_oid"), F.col("value").alias("value")).alias("c")))
    rows = cells.groupBy("place").agg(F.first("row").alias("row"), F.sort_array(F.collect_list(cell)).alias("cells"))
    after = F.when(F.col("row.after").isNotNull(), F.transform("cells", lambda x: x["c"]))
    return rows.select(F.col("row").withField("after", after).alias("row")).select("row.*")


# ---- building frames (tests, captures) -----------------------------------------------------------------------


def begin_frame(final_lsn: int, ts_us: int, xid: int) -> bytes:
    return b"B" + struct.pack(">qqI", final_lsn, ts_us - EPOCH_US, xid)


def commit_frame(lsn: int) -> bytes:
    return b"C\0" + struct.pack(">qqq", lsn, lsn, 0)


def relation_frame(oid: int, schema: str, table: str, columns: list[tuple[str, int]], identity: str = "d", keys: int = 1) -> bytes:
    cols = b"".join(struct.pack(">B", k < keys) + n.encode() + b"\0" + struct.pack(">Ii", o, -1) for k, (n, o) in enumerate(columns))
    return b"R" + struct.pack(">I", oid) + schema.encode() + b"\0" + table.encode() + b"\0" + identity.encode() + struct.pack(">H", len(columns)) + cols


def row_bytes(values: list) -> bytes:
    """None is NULL, ``...`` an unchanged value, bytes a binary one."""
    out = struct.pack(">H", len(values))
    for v in values:
        if v is None or v is ...:
            out += b"n" if v is None else b"u"
        else:
            data = v if isinstance(v, bytes) else str(v).encode()
            out += (b"b" if isinstance(v, bytes) else b"t") + struct.pack(">I", len(data)) + data
    return out


def insert_frame(oid: int, values: list) -> bytes:
    return b"I" + struct.pack(">I", oid) + b"N" + row_bytes(values)


def update_frame(oid: int, values: list, old: list | None = None, tag: bytes = b"K") -> bytes:
    return b"U" + struct.pack(">I", oid) + (tag + row_bytes(old) if old is not None else b"") + b"N" + row_bytes(values)


def delete_frame(oid: int, old: list) -> bytes:
    return b"D" + struct.pack(">I", oid) + b"K" + row_bytes(old)


def truncate_frame(oids: list[int]) -> bytes:
    return b"T" + struct.pack(">IB", len(oids), 0) + b"".join(struct.pack(">I", o) for o in oids)


def message_frame(lsn: int, prefix: str, content: str) -> bytes:
    data = content.encode()
    return b"M\1" + struct.pack(">q", lsn) + prefix.encode() + b"\0" + struct.pack(">I", len(data)) + data


FRAME_SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("lsn", T.LongType()), T.StructField("data", T.BinaryType())])

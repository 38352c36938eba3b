"""The binary event codec.

Big-endian: lsn u64, xid u32, op letter, schema and table (u16 length each), fingerprint u64, commit time u64, then the
row after and the row before. A row is a flag byte, and if it is there a u16 number of columns with, for each, its name
(u16 length), type OID u32, a flag byte and the value (u32 length). Encoding is a native expression; decoding
cuts the payloads of an Arrow batch by numpy, a field of all of them at a time. A name that is too long fails instead
of being cut.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import MalformedPayload
from tidelog.functions.wire import Cursor, binary_buffer, damaged_texts, gathered, texts
from tidelog.schema import CHANGE_SCHEMA, OPS, op_letter


def _number(value: Column, n: int) -> Column:
    return F.lpad(F.hex(value), 2 * n, "0")


def _text(value: Column, n: int) -> Column:
    size = F.octet_length(value)
    most = (1 << (8 * n)) - 1
    checked = F.when(size <= most, size).otherwise(F.raise_error(F.lit(f"a text of over {most} bytes")).cast("int"))
    return F.concat(_number(checked.cast("long"), n), F.hex(value.cast("binary")))


def _row(data: Column) -> Column:
    value = lambda c: F.when(c["value"].isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), _text(c["value"], 4)))
    one = lambda c: F.concat(_text(c["name"], 2), _number(c["type_oid"], 4), value(c))
    whole = F.concat(F.lit("01"), _number(F.size(data).cast("long"), 2), F.array_join(F.transform(data, one), ""))
    return F.when(data.isNull(), F.lit("00")).otherwise(whole)


def encoded() -> Column:
    """An event as bytes."""
    head = F.concat(_number(F.col("lsn"), 8), _number(F.col("xid"), 4), F.hex(op_letter(F.col("op")).cast("binary")))
    table = F.concat(_text(F.col("table.schema"), 2), _text(F.col("table.table"), 2))
    tail = F.concat(F.lpad("schema_fingerprint", 16, "0"), _number(F.col("commit_timestamp_us"), 8))
    return F.unhex(F.concat(head, table, tail, _row(F.col("after")), _row(F.col("before"))))


def stored(events: DataFrame) -> DataFrame:
    """At rest: header columns for pruning, the whole event as payload."""
    return events.select("lsn", "xid", F.array_position(F.array(*map(F.lit, OPS)), F.col("op")).cast("int").alias("op_code"), F.col("table.schema").alias("table_schema"), F.col("table.table").alias("table_name"), encoded().alias("payload"))


def decode_one(data: bytes) -> dict:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise MalformedPayload(f"{n} bytes wanted at {at} of {len(data)}")
        at += n
        return data[at - n : at]

    def number(n: int) -> int:
        return int.from_bytes(take(n), "big")

    def text(n: int) -> str:
        return take(number(n)).decode()

    def row() -> list[dict] | None:
        if at >= len(data) or not number(1):
            return None
        return [{"name": text(2), "type_oid": number(4), "value": text(4) if number(1) else None} for _ in range(number(2))]

    lsn, xid, letter = number(8), number(4), take(1).decode("latin-1")
    op = next((o for o in OPS if o[0].upper() == letter), None)
    if op is None:
        raise MalformedPayload(f"no operation {letter!r}")
    table = {"schema": text(2), "table": text(2)}
    fingerprint, ts = f"{number(8):016x}", struct.unpack(">q", take(8))[0]
    return {"lsn": lsn, "xid": xid, "op": op, "table": table, "schema_fingerprint": fingerprint, "after": row(), "before": row(), "commit_timestamp_us": ts}


_ROW = pa.list_(pa.struct([("name", pa.string()), ("type_oid", pa.int64()), ("value", pa.string())]))
_ARROW = pa.schema([("lsn", pa.int64()), ("xid", pa.int64()), ("op", pa.string()), ("table", pa.struct([("schema", pa.string()), ("table", pa.string())])), ("schema_fingerprint", pa.string()), ("after", _ROW), ("before", _ROW), ("commit_timestamp_us", pa.int64())])


_LETTERS = np.full(256, -1)
_LETTERS[[ord(o[0].upper()) for o in OPS]] = range(len(OPS))
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint8).reshape(256, 2)


def _read_row(c: Cursor) -> tuple:
    """Number of columns of every event (-1: no row), then for all columns: event, name, type, whether there is a value, value."""
    every = np.arange(len(c.at))
    more = every[c.ok & (c.at < c.end)]  # a payload may end before its rows
    there = more[c.number(more, 1) != 0]
    count = np.full(len(every), -1, np.int64)
    count[there] = c.number(there, 2)
    found, k = [], 0
    while len(now := there[c.ok[there] & (count[there] > k)]):
        name, name_size = c.span(now, 2)
        oid, flag = c.number(now, 4), c.number(now, 1) != 0
        value, value_size = np.zeros(len(now), np.int64), np.zeros(len(now), np.int64)
        value[flag], value_size[flag] = c.span(now[flag], 4)
        found.append((now, name, name_size, oid, flag, value, value_size))
        k += 1
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)] + [np.zeros(0, np.int64)] * 2
    for first, size in ((1, 2), (5, 6)):
        c.ok[columns[0][damaged_texts(c.buf, columns[first], columns[size])]] = False
    return count, columns


def _row_array(buf: np.ndarray, good: np.ndarray, count: np.ndarray, columns: list[np.ndarray]) -> pa.Array:
    own = good[columns[0]]
    columns = [x[own] for x in columns]
    order = np.argsort(columns[0], kind="stable")
    _, name, name_size, oid, flag, value, value_size = (x[order] for x in columns)
    cells = pa.StructArray.from_arrays([texts(gathered(buf, name, name_size), name_size), pa.array(oid), texts(gathered(buf, value, value_size), value_size, flag)], fields=list(_ROW.value_type))
    count = count[good]
    lists = np.concatenate(([0], np.cumsum(np.maximum(count, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), cells, mask=pa.array(count < 0))


def decoded(data: pa.Array) -> tuple[pa.RecordBatch, np.ndarray]:
    """The events of a binary array, and which of its values are none."""
    buf, begin, end = binary_buffer(data)
    c, every = Cursor(buf, begin, end), np.arange(len(data))
    lsn, xid, op = c.number(every, 8), c.number(every, 4), _LETTERS[c.number(every, 1)]
    c.ok &= (op >= 0) & (lsn >= 0) & data.is_valid().to_numpy(zero_copy_only=False)
    names = [c.span(every, 2) for _ in range(2)]
    for first, size in names:
        c.ok[damaged_texts(buf, first, size)] = False
    fits, at = c.skip(every, 8)
    ts = c.number(every, 8)
    images = [_read_row(c) for _ in range(2)]
    good = c.ok
    prints = _HEX[buf[at[good][:, None] + np.arange(8)]].ravel() if good.any() else np.zeros(0, np.uint8)
    table = [texts(gathered(buf, first[good], size[good]), size[good]) for first, size in names]
    arrays = {
        "lsn": pa.array(lsn[good]), "xid": pa.array(xid[good]), "op": pa.DictionaryArray.from_arrays(pa.array(op[good]), pa.array(OPS)).cast(pa.string()),
        "table": pa.StructArray.from_arrays(table, fields=list(_ARROW.field("table").type)), "schema_fingerprint": texts(prints, np.full(int(good.sum()), 16)),
        "after": _row_array(buf, good, *images[0]), "before": _row_array(buf, good, *images[1]), "commit_timestamp_us": pa.array(ts[good]),
    }
    return pa.RecordBatch.from_arrays([arrays[f.name] for f in _ARROW], schema=_ARROW), np.flatnonzero(~good)


def decode(rows: DataFrame, payload: str = "payload", strict: bool = False) -> DataFrame:
    """Events of encoded payloads; those that cannot be read fail the query or are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events, bad = decoded(batch.column(0))
            for k in bad.tolist() if strict else ():
                decode_one(batch.column(0)[k].as_py() or b"")
                raise MalformedPayload(f"payload {k} of a batch")
            yield events

    return rows.select(payload).mapInArrow(run, CHANGE_SCHEMA)

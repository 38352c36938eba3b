"""FNV-1a in Spark and Python, schema fingerprints, signatures, hex."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = 0xCBF29CE484222325
_PRIME = 0x100000001B3
_LOW = 0xFFFFFFFF


def fnv1a(data: bytes) -> int:
    h = _OFFSET
    for byte in data:
        h = ((h ^ byte) * _PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_hex(text: Column) -> Column:
    """Sixteen lower-case hex digits of FNV-1a 64 of a text's UTF-8 bytes.

    The state is two 32-bit halves, so no product leaves the range of a long. The prime is 2**40 + 435.
    """
    digits = F.hex(text.cast("binary"))
    places = F.filter(F.sequence(F.lit(0), F.octet_length(text)), lambda i: i < F.octet_length(text))
    byte = lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    start = F.struct(F.lit(_OFFSET >> 32).cast("long").alias("hi"), F.lit(_OFFSET & _LOW).cast("long").alias("lo"))

    def step(state: Column, i: Column) -> Column:
        t = state["lo"].bitwiseXOR(byte(i))
        product = t * F.lit(435).cast("long")
        high = (state["hi"] * F.lit(435).cast("long") + t * F.lit(256).cast("long") + F.shiftright(product, 32)).bitwiseAND(F.lit(_LOW))
        return F.struct(high.alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    done = lambda s: F.concat(F.lpad(F.lower(F.hex(s["hi"])), 8, "0"), F.lpad(F.lower(F.hex(s["lo"])), 8, "0"))
    return F.aggregate(places, start, step, done)


def fingerprint_text(schema: str, table: str, columns: list[tuple[str, str]]) -> str:
    return f"{schema}.{table}" + "".join(f"|{name}:{kind}" for name, kind in columns)


def fingerprint(schema: str, table: str, columns: list[tuple[str, str]]) -> str:
    """A table's fingerprint: its name and its columns' names and types, in order."""
    return f"{fnv1a(fingerprint_text(schema, table, columns).encode()):016x}"


def fingerprint_column(schema: Column, table: Column, columns: Column) -> Column:
    """The same for a column of array<struct<name,type_name>>."""
    parts = F.transform(columns, lambda c: F.concat(F.lit("|"), c["name"], F.lit(":"), c["type_name"]))
    return fnv1a_hex(F.concat(schema, F.lit("."), table, F.array_join(parts, "")))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def hmac_sha256(secret: str, data: Column) -> Column:
    """HMAC-SHA256 of a text or binary column as lower-case hex digits."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data.cast("binary")), 256))), 256)


def signature(secret: str, payload: bytes, compat: bool = False) -> str:
    """A payload's signature header: HMAC-SHA256, or FNV-1a of secret and payload for old receivers."""
    if compat:
        return f"sha256={fnv1a(secret.encode() + payload):x}"
    return "sha256=" + hmac.new(secret.encode(), payload, hashlib.sha256).hexdigest()

"""Log sequence numbers: text form, order, saturating arithmetic, big-endian bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import MalformedLsn
from tidelog.schema import LSN_MAX

_TEXT = r"^([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})$"


def parse(text: Column) -> Column:
    """``X/Y`` as a long; null where it is malformed or beyond the signed range."""
    high, low = (F.conv(F.regexp_extract(text, _TEXT, i), 16, 10).try_cast("bigint") for i in (1, 2))
    return F.when(F.regexp_like(text, F.lit(_TEXT)) & (high < 1 << 31), high * F.lit(1 << 32) + low)


def parse_strict(text: Column) -> Column:
    """As ``parse``, but a malformed text fails the query."""
    return F.coalesce(parse(text), F.raise_error(F.concat(F.lit("malformed LSN: "), F.coalesce(text, F.lit("null")))).cast("bigint"))


def format(lsn: Column) -> Column:  # noqa: A001
    """Upper-case, unpadded ``X/Y``."""
    return format_halves(F.shiftrightunsigned(lsn, 32), lsn.bitwiseAND(F.lit(0xFFFFFFFF)))


def format_halves(high: Column, low: Column) -> Column:
    """Two numbers as ``X/Y``, also where the second is beyond 32 bits; nothing is carried, so ``parse`` rejects such a text."""
    return F.concat(F.hex(high), F.lit("/"), F.hex(low))


def add(lsn: Column, n: Column | int) -> Column:
    """Addition that stops at the largest LSN."""
    return F.coalesce(F.try_add(lsn, F.lit(n) if isinstance(n, int) else n), F.when(lsn.isNotNull(), F.lit(LSN_MAX)))


def distance(start: Column, end: Column) -> Column:
    """``end - start``, at least 0."""
    return F.greatest(end - start, F.lit(0))


def to_bytes(lsn: Column) -> Column:
    """Eight big-endian bytes, whose order is the order of the numbers."""
    return F.unhex(F.lpad(F.hex(lsn), 16, "0"))


def log_key(lsn: Column, xid: Column) -> Column:
    """Eight bytes of the LSN, then four of the transaction."""
    return F.concat(to_bytes(lsn), F.unhex(F.lpad(F.hex(xid), 8, "0")))


def from_bytes(key: Column) -> Column:
    """The LSN of a key; null under eight bytes."""
    return F.when(F.octet_length(key) >= 8, F.conv(F.hex(F.substring(key, 1, 8)), 16, 10).try_cast("bigint"))


def key_in_range(key: Column, low: int, high: int) -> Column:
    """Whether a key may be of an event in [low, high]; short keys are not."""
    return F.coalesce(from_bytes(key).between(low, high), F.lit(False))


def parse_text(text: str) -> int:
    """The same in Python; raises MalformedLsn."""
    high, slash, low = text.partition("/")
    try:
        if not slash or not (0 < len(high) <= 8 and 0 < len(low) <= 8):
            raise ValueError
        return (int(high, 16) << 32) | int(low, 16)
    except ValueError:
        raise MalformedLsn(text) from None


def format_text(lsn: int) -> str:
    return f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}"

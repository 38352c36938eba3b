"""Column encryption: AES-GCM with a nonce that follows from the key and the value's place, so a rerun gives the same bytes.

A nonce may serve one plaintext only under a key. It is a keyed hash of everything that tells two values apart: the
position, the table, which image of the row, the place and name of the column, and the value itself. So rows that share
a position, as those of a snapshot do, and both images of one event have nonces of their own; only equal values at
equal places repeat a nonce, and give the same bytes. Another key, as after a rotation, gives another nonce.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nonce(key: Column, image: str, place: Column, name: Column, value: Column) -> Column:
    """Twelve bytes: a hash with the key inside and outside, as an HMAC has it."""
    about = F.to_json(F.array(F.lit(image), F.col("lsn").cast("string"), F.col("xid").cast("string"), F.col("table.schema"), F.col("table.table"), place.cast("string"), name, value))
    inner = F.unhex(F.sha2(F.concat(key, F.lit(b"inner"), about.cast("binary")), 256))
    return F.unhex(F.substring(F.sha2(F.concat(key, F.lit(b"outer"), inner), 256), 1, 24))


def _mapped(data: Column, names: list[str], change: Callable[[Column, Column, Column], Column]) -> Column:
    chosen = lambda c: c["name"].isin(*names) & c["value"].isNotNull()
    return F.transform(data, lambda c, i: F.struct(c["name"].alias("name"), c["type_oid"].alias("type_oid"), F.when(chosen(c), change(c["value"], c["name"], i)).otherwise(c["value"]).alias("value")))


def encrypt(events: DataFrame, names: list[str], key: Column, image: str = "after") -> DataFrame:
    """Values of the named columns as base64 of nonce, ciphertext and tag; the name is authenticated."""
    change = lambda value, name, place: F.base64(F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), nonce(key, image, place, name, value), name))
    return events.withColumn(image, _mapped(F.col(image), names, change))


def decrypt(events: DataFrame, names: list[str], key: Column, image: str = "after") -> DataFrame:
    """The plain values; what the key does not open stays as it is."""
    open_ = lambda value, name, place: F.coalesce(F.try_aes_decrypt(F.unbase64(value), key, F.lit("GCM"), F.lit("DEFAULT"), name).cast("string"), value)
    return events.withColumn(image, _mapped(F.col(image), names, open_))


def rotate(events: DataFrame, names: list[str], old: Column, new: Column, image: str = "after") -> DataFrame:
    """The same values under another key."""
    return encrypt(decrypt(events, names, old, image), names, new, image)

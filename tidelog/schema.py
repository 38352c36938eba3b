"""The canonical change event, its row type, and what is derived from one event.

An event has a position in the log (``lsn``, ``xid``), an operation, a table, the fingerprint of the table's schema and
the row after and before the change. A row is an array of (name, type_oid, value): order, repeated names and OIDs are
kept, values are text and null is SQL NULL. ``after`` and ``before`` that are null are absent, which is not the same as
a row without columns.

LSNs are unsigned 64-bit in the protocol and signed here; ``LSN_MAX`` (2**63 - 1) stands for the largest, and additions
stop there. Real positions never come near it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_TYPE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type_oid", T.LongType()), T.StructField("value", T.StringType())]))
TABLE_TYPE = T.StructType([T.StructField("schema", T.StringType()), T.StructField("table", T.StringType())])
CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("lsn", T.LongType()),
        T.StructField("xid", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("table", TABLE_TYPE),
        T.StructField("schema_fingerprint", T.StringType()),
        T.StructField("after", ROW_TYPE),
        T.StructField("before", ROW_TYPE),
        T.StructField("commit_timestamp_us", T.LongType()),
    ]
)
OPS = ("insert", "update", "delete", "truncate")
LSN_MAX = 9_223_372_036_854_775_807
#: Bytes that an event takes besides its names and values; a build's own constant, so a parameter of ``event_size``.
EVENT_BASE_BYTES = 144


def row(**columns: Column) -> Column:
    """A row of text values from columns, type OIDs 0."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(0).cast("long").alias("type_oid"), c.cast("string").alias("value")) for n, c in columns.items()])


def table_id(schema: str | Column, table: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(schema).alias("schema"), lit(table).alias("table"))


def qualified(table: Column | str = "table") -> Column:
    """``schema.table``."""
    table = F.col(table) if isinstance(table, str) else table
    return F.concat_ws(".", table["schema"], table["table"])


def is_table(*names: str, table: Column | str = "table") -> Column:
    """Whether an event's table has one of the qualified names, by its fields: a scan can use that, unlike the joined name."""
    table = F.col(table) if isinstance(table, str) else table
    found = F.lit(False)
    for name in names:
        parts = name.split(".")
        for k in range(1, len(parts)):  # a dot may be part of either
            found = found | ((table["schema"] == ".".join(parts[:k])) & (table["table"] == ".".join(parts[k:])))
        if len(parts) == 1:
            found = found | (qualified(table) == name)
    return found


def split_qualified(name: Column) -> Column:
    """(schema, table) of a name, cut at its first dot; null without one."""
    at = F.instr(name, ".")
    return F.when(at > 0, F.struct(F.substr(name, F.lit(1), at - 1).alias("schema"), F.substr(name, at + 1).alias("table")))


def has(data: Column, name: str) -> Column:
    return F.coalesce(F.exists(data, lambda c: c["name"] == name), F.lit(False))


def text(data: Column, name: str) -> Column:
    """The value of the first column of that name; null where it is missing or NULL."""
    return F.try_element_at(F.filter(data, lambda c: c["name"] == name), F.lit(1))["value"]


def op_of(tag: Column) -> Column:
    """An operation from its lower-case, upper-case or one-letter tag; null for any other spelling."""
    found = F.lit(None).cast("string")
    for op in OPS:
        found = F.when(tag.isin(op, op.upper(), op[0].upper()), op).otherwise(found)
    return found


def op_letter(op: Column) -> Column:
    return F.when(op.isin(*OPS), F.upper(F.substring(op, 1, 1)))


def op_number(op: Column) -> Column:
    """1 to 4; 0 for anything else."""
    return F.array_position(F.array(*map(F.lit, OPS)), F.coalesce(op, F.lit(""))).cast("int")


def is_data(op: Column) -> Column:
    return op.isin("insert", "update", "delete")


def is_truncate(op: Column) -> Column:
    return op == "truncate"


def _row_bytes(data: Column) -> Column:
    return F.coalesce(F.aggregate(data, F.lit(0), lambda a, c: a + F.octet_length(c["name"]) + F.coalesce(F.octet_length(c["value"]), F.lit(0))), F.lit(0))


def event_size(base: int = EVENT_BASE_BYTES) -> Column:
    """Bytes that an event takes in memory: a constant plus the UTF-8 bytes of names and values."""
    table = F.octet_length(F.col("table.schema")) + F.octet_length(F.col("table.table"))
    return (F.lit(base) + table + _row_bytes(F.col("after")) + _row_bytes(F.col("before"))).cast("long")


def typed(data: Column, columns: dict[str, str]) -> Column:
    """A struct of the named columns cast to Spark types; ``t``/``true`` are true, malformed text is null."""

    def cast(name: str, kind: str) -> Column:
        value = text(data, name)
        if kind == "boolean":
            return F.when(value.isNotNull(), F.lower(value).isin("t", "true"))
        return value.try_cast(kind)

    return F.struct(*[cast(n, k).alias(n) for n, k in columns.items()])


#: PostgreSQL type OIDs and the Spark types of the typed view (fixed values).
OID_TYPES = {16: "boolean", 20: "bigint", 21: "bigint", 23: "bigint", 25: "string", 114: "string", 700: "double", 701: "double", 1042: "string", 1043: "string", 1082: "date", 1114: "timestamp_ntz", 1184: "timestamp", 1700: "decimal(38,9)", 2950: "string", 3802: "string"}


def typed_by_oid(data: Column, oids: dict[str, int]) -> Column:
    return typed(data, {n: OID_TYPES.get(o, "string") for n, o in oids.items()})


def empty_log(spark) -> DataFrame:
    return spark.createDataFrame([], CHANGE_SCHEMA)

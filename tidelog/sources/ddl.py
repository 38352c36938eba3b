"""DDL messages: ``KIND|schema.table|statement``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import MalformedPayload

#: Tags and kinds (fixed values). A tag with a space is the command tag of an event trigger.
KINDS = {"ALTER_TABLE": "AlterTable", "DROP_TABLE": "DropTable", "RENAME_TABLE": "RenameTable", "ADD_COLUMN": "AddColumn", "DROP_COLUMN": "DropColumn", "ALTER_COLUMN": "AlterColumn"}


def parse(messages: DataFrame, strict: bool = False) -> DataFrame:
    """(lsn, table, kind, detail, statement) of (lsn, content); a message with under three parts fails or is left out."""
    # the statement may hold bars itself: only the first two cut
    pattern = r"(?s)^([^|]*)\|([^|]*)\|(.*)$"
    part = lambda i: F.regexp_extract("content", pattern, i)
    whole = F.coalesce(F.regexp_like(F.col("content"), F.lit(pattern)), F.lit(False))
    if strict:
        messages = messages.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed DDL message: "), F.coalesce("content", F.lit("null")))).cast("boolean")))
    else:
        messages = messages.where(whole)
    tag = F.translate(part(1), " ", "_")
    kind = F.lit("Other")
    for name, value in KINDS.items():
        kind = F.when(tag == name, value).otherwise(kind)
    rows = messages.select("lsn", part(2).alias("table"), kind.alias("kind"), part(3).alias("statement"))
    return rows.select("lsn", "table", "kind", detail(F.col("kind"), F.col("statement")).alias("detail"), "statement")


def detail(kind: Column, statement: Column) -> Column:
    """The new name of a rename, the column of a column change (empty if it is not found); null for other kinds."""
    after = lambda words: F.rtrim(F.regexp_extract(statement, rf"(?is){words}\s*(\S+)", 1), F.lit(";"))
    return F.when(kind == "RenameTable", after("RENAME TO ")).when(kind.isin("AddColumn", "DropColumn", "AlterColumn"), after("COLUMN "))


def parse_one(content: str) -> tuple[str, str, str]:
    """Tag, table and statement in Python; raises MalformedPayload."""
    parts = content.split("|", 2)
    if len(parts) < 3:
        raise MalformedPayload(f"a DDL message has three parts: {content!r}")
    return tuple(parts)


def monitored(changes: DataFrame, tables: list[str]) -> DataFrame:
    """Only changes of the given tables."""
    return changes.where(F.col("table").isin(*tables) if tables else F.lit(False))


def drain(changes: DataFrame, lsn: int) -> tuple[DataFrame, DataFrame]:
    """Changes up to an LSN, and those that stay."""
    return changes.where(F.col("lsn") <= lsn), changes.where(F.col("lsn") > lsn)


def capture(tag: str, table: str, statement: str) -> str:
    """The message that a source emits for a statement."""
    return f"{tag.replace(' ', '_')}|{table}|{statement}"


def captured(tag: Column, table: Column, statement: Column) -> Column:
    """The same message from columns."""
    return F.concat_ws("|", F.replace(tag, F.lit(" "), F.lit("_")), table, statement)


def capture_drop(table: str) -> str:
    return capture("DROP_TABLE", table, "DROP TABLE")

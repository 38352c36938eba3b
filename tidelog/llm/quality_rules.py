"""Operator 6: rule-based quality with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: its words, symbols, repeated lines and words inside 5-word windows that occur twice.
The cross-document rule hashes normalised lines (lower case, digits as 0, runs of white space as one space), counts
for each host the distinct texts with a line, and removes lines above the limit ``max(LINE_DOCS, LINE_SHARE x the
host's distinct texts)``, which is ``MOST_LINE_DOCS`` at most however large the host is. A document whose removed lines hold more than ``DEPLETED`` of its words is rejected.

Copies of a document are not boilerplate, but the duplicate operators' business: documents of a host with equal texts
count as one, both for a line and for the host. Every line above the limit is removed, whatever its neighbours.

Scale: texts never leave their scans. Lines are normalised and hashed in one of them, into a table of hashes and word
counts in the shared folder, which both the counting and the removal read. The line hashes of equal texts are merged
and counted with map-side combination, the few frequent ones are joined back to the lines (Spark broadcasts them only
if their measured size allows and splits a skewed join), and the sums of a document are joined to its statistics. A
hot host is a hot key of a pre-aggregated count only, as the line hash is part of every key.

Edge cases: null and empty texts have no words and fail the base rules; a null host is a host; repeated rows and
repeated doc_ids each get their own result row; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import stored, whole_rows, work_dir

WINDOW = 5
LINE_DOCS = 10
LINE_SHARE = 0.002
#: The limit of a line never rises above this many distinct texts.
MOST_LINE_DOCS = 100
DEPLETED = 0.7
_SPACE = "[\\x20\\x09-\\x0D]+"
_STRIP = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (inside a lambda an expression would be computed for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text that is not null."""
    bare = F.btrim(text, F.lit(_STRIP))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more, given the words of a text."""

    def covered(positions: Column) -> Column:
        span = F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1), p + WINDOW) - p))
        return F.aggregate(span, F.lit(0), lambda a, x: a + x)

    def twice(marked: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(marked, i)["h"] == F.get(marked, j)["h"], F.lit(False))
        picked = F.filter(marked, lambda x, i: same(i, i - 1) | same(i, i + 1))
        return let(F.sort_array(F.transform(picked, lambda x: x["i"])), covered)

    def of_windows(hashes: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(marked), twice))

    def of_words(hashes: Column) -> Column:
        windows = F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
        return F.when(F.size(hashes) < WINDOW + 1, F.lit(0)).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_STRIP)) != "")
    both = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    return {
        "both": both,
        "word_chars": F.length(F.translate(text, _STRIP, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def normal_line(line: Column) -> Column:
    return F.btrim(F.lower(F.translate(F.regexp_replace(line, _SPACE, " "), "123456789", "0" * 9)))


def _keyed(docs: DataFrame) -> DataFrame:
    host = F.col("source").cast("string")
    return docs.select(F.col("doc_id"), host.alias("host"), F.xxhash64("doc_id", host, "text").alias("key"), "text")


def _lines(keyed: DataFrame) -> DataFrame:
    """The lines with a word of each document: doc_id, key, host, t (hash of the text), lines (h, n: words)."""
    bare = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), normal_line), lambda x: x != "")
    hashed = F.transform(bare, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))
    return keyed.select("doc_id", "key", "host", F.xxhash64("text").alias("t"), hashed.alias("lines"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """(host, h): the lines that are removed, given the lines of all documents."""
    once = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    texts = lines.select("host", "t", once.alias("once")).groupBy("host", "t").agg(F.first("once").alias("once"))
    counts = texts.select("host", F.explode("once").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > LINE_DOCS)
    hosts = lines.select("host", "t").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")).withColumnRenamed("host", "host_")
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("n_docs") > F.least(F.lit(MOST_LINE_DOCS), LINE_SHARE * F.col("host_docs"))).select("host", "h")


def _removed(keyed: DataFrame) -> DataFrame:
    """(doc_id, key, removed_words, removed): for each document with removed lines, their words and hashes."""
    lines = stored(_lines(keyed), work_dir(keyed.sparkSession, "lines"))
    bad = boilerplate(lines).select(F.col("host").alias("host_"), F.col("h").alias("h_"))
    each = lines.select("doc_id", "key", "host", F.posexplode("lines").alias("at", "l")).select("doc_id", "key", "host", "at", "l.*")
    hit = each.join(bad, (F.col("h") == F.col("h_")) & F.col("host").eqNullSafe(F.col("host_")))
    found = hit.groupBy("doc_id", "key", "at").agg(F.first("n").alias("n"), F.first("h").alias("h"))  # equal rows once
    return found.groupBy("doc_id", "key").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("removed"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, removed_words and key (of the row, for joining back)."""
    keyed = _keyed(docs)
    base = keyed.select("doc_id", "key", *[c.alias(n) for n, c in base_columns(F.col("text")).items()])
    base = base.select("doc_id", "key", F.col("both.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("both.r").cast("long").alias("n_repeat_words"))
    gone = _removed(keyed).select(F.col("doc_id").alias("doc_id_"), F.col("key").alias("key_"), "removed_words", "removed")
    joined = base.join(gone, (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")), "left")
    lost = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (lost <= DEPLETED * F.col("n_words"))).alias("kept"), lost.alias("removed_words"), "key", "removed",
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; the columns of ``docs``, n_chars anew."""
    verdict = quality_rules(docs).where("kept").groupBy("doc_id", "key").agg(F.first("removed").alias("removed_"))
    verdict = verdict.select(F.col("doc_id").alias("doc_id_"), F.col("key").alias("key_"), "removed_")
    own = whole_rows(docs).withColumn("key", F.xxhash64("row.doc_id", F.col("row.source").cast("string"), "row.text"))
    joined = own.join(verdict, (F.col("key") == F.col("key_")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id_")))
    left = F.filter(F.split("row.text", "\n", -1), lambda x: ~F.array_contains("removed_", F.xxhash64(normal_line(x))))
    text = F.when(F.col("removed_").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    cleaned = joined.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast("long")))
    return cleaned.select("row.*")

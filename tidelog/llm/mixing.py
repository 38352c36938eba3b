"""Operator 4: mixing sources to target weights, in DataFrame functions only.

Documents of a source stand in a fixed order and their words are packed into blocks of ``block_words``. A source's
target is its share by weight of all words, at most ``MOST_PASSES`` times its size, with the excess shared anew by
weight. A target becomes a number of slots: whole passes over the source's blocks, then part of one. The output has a
shard for every ``shard_slots`` slots; how many slots of each source a shard has is drawn (each slot falls on a shard
with equal chance, so a source's counts over the shards are multinomial, and their sum is the source's number of
slots, which meets its target to half a block). The counts number the slots: those of a source's first shard are its
slots from 0 on, then come those of its next. Slot k of a source takes the block that the pass's pseudorandom
permutation gives for index k (a swap-or-not shuffle, which permutes any number of blocks), so no block is taken twice
in a pass. Blocks and slots are joined by their index.

Scale: texts are read once for their sizes; all else moves rows of a few numbers. Every prefix sum is taken inside
chunks and then over the chunks' totals, so a source that holds a third of all rows is many windows. The order of the
sources is a range partitioning, and the level up to which they fill is found by a few sums over them, so hosts by the
million may be sources. Only the table of sources (a row each) meets the rest by its source, and Spark broadcasts it
if its measured size allows.

Edge cases: null and empty texts have size 0, are in no block and take 0; a null source comes last; a null doc_id
comes first in its chunk; equal rows and repeated doc_ids each get their own row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import WORD, stored, whole_rows, work_dir

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Slots in a range that one row enumerates, and in a task; shards whose counts are summed up in one window.
RANGE_SLOTS = 4_096
TASK_SLOTS = 65_536
CHUNK_SHARDS = 1_024
#: Rounds of the permutation, and the prime and multiplier of its integer hash.
ROUNDS = 16
PRIME = 2_147_483_647
FACTOR = 48_271


def key_of(a: Column, b: Column, c: Column) -> Column:
    """A number below PRIME from three small numbers."""
    return F.pmod((F.pmod(a * 7919 + b * 104_729 + c * 1_299_709 + 17, F.lit(PRIME)) + 1) * FACTOR, F.lit(PRIME))


def permuted(index: Column, n: Column, source: Column, turn: Column) -> Column:
    """Where the permutation of (source, turn) sends an index below n."""

    def swap(x: Column, k: Column) -> Column:
        partner = F.pmod(key_of(source, turn, k) - x, n)
        h = F.pmod((F.pmod(F.greatest(x, partner), F.lit(PRIME)) + 1) * key_of(source, turn, k + ROUNDS), F.lit(PRIME))
        return F.when(F.pmod((F.pmod(h * h, F.lit(PRIME)) / 1024).cast("long"), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in range(ROUNDS)]), index, swap)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a key of the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = F.col("source").cast("string")
    return docs.select("doc_id", source.alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", source, "text").alias("row_key"))


def ranked(totals: DataFrame, folder: str) -> DataFrame:
    """Sources with ``rank``, their place by code point (null last)."""
    order = (F.col("source").isNull(), F.col("source"))
    dealt = stored(totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id().cast("long")), f"{folder}/ordered")
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(F.col("part").alias("part_"), before.alias("before"))  # a row for each partition
    placed = dealt.withColumn("inner", inner).join(parts, F.col("part") == F.col("part_"))
    return placed.select("source", "source_size", (F.col("inner") + F.col("before")).cast("long").alias("rank"))


def source_targets(sizes: DataFrame, folder: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each source: rank, source, source_size, weight, target, n_blocks, n_slots."""
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank"), F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    known = stored(ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), folder).withColumn("weight", weight), f"{folder}/ranked")
    # pour by weight: a source is full at its level of words for each weight; the level rises until no other is full
    full, most = F.col("source_size") * MOST_PASSES / F.col("weight"), F.col("source_size") * MOST_PASSES
    level, n_full = -1.0, -1
    while True:
        filled = full < F.lit(level)
        sums = known.agg(F.sum("source_size"), F.sum(F.when(filled, F.col("source_size"))), F.sum(F.when(~filled, F.col("weight"))), F.count_if(filled)).first()
        if not sums[2] or sums[3] == n_full:
            break
        n_full, level = sums[3], (sums[0] - (sums[1] or 0) * MOST_PASSES) / sums[2]
    target = F.least(most.cast("double"), F.when(full < F.lit(level), most.cast("double")).otherwise(F.lit(level) * F.col("weight")))
    with_target = known.select("rank", "source", "source_size", "weight", target.alias("target")).withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0)
    return with_target.withColumn("n_slots", F.least(slots.cast("long"), F.col("n_blocks") * MOST_PASSES))


def sums_before(rows: DataFrame, by: str, chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of ``by`` that come before, in the order of chunk and ``order``."""
    inside = Window.partitionBy(by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(F.col(by).alias("by_"), F.col(chunk).alias("chunk_")).agg(F.sum(value).alias("n_"))
    base = F.coalesce(F.sum("n_").over(Window.partitionBy("by_").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = rows.withColumn("inner_", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = known.join(chunks.select("by_", "chunk_", base.alias("base_")), (F.col(by) == F.col("by_")) & (F.col(chunk) == F.col("chunk_")))
    return joined.withColumn(name, F.col("base_") + F.col("inner_")).drop("by_", "chunk_", "base_", "inner_")


def packed(sizes: DataFrame, sources: DataFrame, n_docs: int) -> DataFrame:
    """The documents with their place: rank, chunk, seq, start (words of the source before it), and the source's row."""
    chunks = max(1, math.isqrt(n_docs))  # as many as documents in each
    known = sources.withColumnRenamed("source", "source_")
    placed = sizes.join(known, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    # an id that many rows share, or none, is spread by their sizes and texts
    own = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.col("row_key")), F.lit(PRIME)) + F.pmod(F.col("size") * 7919, F.lit(PRIME))
    placed = placed.withColumn("chunk", F.pmod(F.pmod((own + 1) * FACTOR, F.lit(PRIME)), F.lit(chunks)))
    order = ["doc_id", "size", "row_key"]
    placed = placed.withColumn("seq", F.row_number().over(Window.partitionBy("rank", "chunk").orderBy(*order)).cast("long"))
    return sums_before(placed, "rank", "chunk", order, "size", "start")


def shard_counts(sources: DataFrame, n_slots: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(rank, n_blocks, shard, n): how many slots of each source a shard has; a slot falls on any shard with equal chance."""
    shards = F.lit(max(1, math.ceil(n_slots / shard_slots))).cast("long")
    ranges = sources.where("n_slots > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / RANGE_SLOTS))))
    ranges = ranges.repartition(max(1, math.ceil(n_slots / TASK_SLOTS)), "rank", "part")
    last = F.least((F.col("part") + 1) * RANGE_SLOTS, F.col("n_slots")) - 1
    each = ranges.select("rank", "n_blocks", F.explode(F.sequence(F.col("part") * RANGE_SLOTS, last)).alias("slot"))
    shard = F.pmod(F.xxhash64("rank", "slot", F.lit(29)), shards)
    return each.groupBy("rank", "n_blocks", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def slots(counts: DataFrame, n_slots: int) -> DataFrame:
    """(rank, shard, slot, turn, block): the slots that the counts give each shard, and the block that each takes."""
    own = sums_before(counts.withColumn("chunk", F.floor(F.col("shard") / CHUNK_SHARDS)), "rank", "chunk", ["shard"], "n", "first")
    own = own.repartition(max(1, math.ceil(n_slots / TASK_SLOTS)), "rank", "shard")
    each = own.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    turn = F.floor(F.col("slot") / F.col("n_blocks"))
    block = permuted(F.pmod(F.col("slot"), F.col("n_blocks")), F.col("n_blocks"), F.col("rank"), turn)
    block = F.coalesce(block, F.lit(0))  # never null, and so known to be: else the join would compute it twice to see
    return each.select("rank", "shard", "slot", turn.alias("turn"), block.alias("block"))


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(rank, block, chunk, seq, doc_id, row_key, first, last): the words [first, last) of a document in a block."""
    end = F.col("start") + F.col("size")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    first = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    return cut.select("rank", "block", "chunk", "seq", "doc_id", "row_key", first.alias("first"), last.alias("last"))


class Mix:
    """The mix of a table of documents: ``sources``, ``placed`` documents and ``spans`` that the mix takes."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS):
        folder = work_dir(docs.sparkSession, "mix")
        sizes = stored(sized(docs), f"{folder}/sizes")
        self.sources = stored(source_targets(sizes, f"{folder}/order", block_words), f"{folder}/sources")
        self.placed = packed(sizes, self.sources, sizes.count())
        parts = pieces(self.placed, block_words)
        n_slots = self.sources.agg(F.sum("n_slots")).first()[0] or 0
        #: How many slots of each source the output shards have: rank, n_blocks, shard, n.
        self.counts = stored(shard_counts(self.sources, n_slots, shard_slots), f"{folder}/counts")
        # counts are few and their slots many: without the hint Spark would take the slots for small and broadcast them
        taken = slots(self.counts, n_slots).hint("merge").withColumnsRenamed({"rank": "rank_", "block": "block_"})
        #: A row for each slot and document in its block: shard, rank, slot, turn, block, doc_id, first, last, ...
        self.spans = taken.join(parts, (F.col("rank") == F.col("rank_")) & (F.col("block") == F.col("block_"))).drop("rank_", "block_")

    def shares(self) -> DataFrame:
        """doc_id, size, source_size, target, taken."""
        place = ("rank", "chunk", "seq")
        taken = self.spans.groupBy(*place).agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
        taken = taken.select(*[F.col(c).alias(c + "_") for c in place], "taken")
        same = (F.col("rank") == F.col("rank_")) & (F.col("chunk") == F.col("chunk_")) & (F.col("seq") == F.col("seq_"))
        joined = self.placed.join(taken, same, "left")
        return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a document a row with the words that it takes, in their order.

    The columns of ``docs``; text is cut to the spans (with the white space before each word), n_chars is counted anew.
    """
    spans = Mix(docs).spans.groupBy("rank", "chunk", "seq", "turn").agg(F.first("row_key").alias("row_key"), F.first("doc_id").alias("doc_id_"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("parts"))
    own = whole_rows(docs).withColumn("key", F.xxhash64("row.doc_id", F.col("row.source").cast("string"), "row.text"))
    once = own.withColumn("id", F.col("row.doc_id")).dropDuplicates(["key", "id"])
    joined = once.join(spans, (F.col("row_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc_id_")))
    words = F.regexp_extract_all("row.text", F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    text = F.transform(F.array(words), lambda w: F.array_join(F.transform("parts", lambda p: F.array_join(F.slice(w, (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int")), "")), ""))
    mixed = joined.withColumn("row", F.col("row").withField("text", F.ltrim(F.element_at(text, 1))))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast("long")))
    return mixed.select("row.*")

"""Operator 5: chat formatting by quotation linking, in DataFrame functions only.

A line's leading ``>`` marks give its quote level. The lines of one level that stand together are a quoted passage;
it and each of its lines are normalised (lower case, white space as one space) and hashed. The lines without marks
are a message's own text; it and each of its lines are hashed likewise. A quotation is linked to the latest earlier
message of its conversation whose own text has the hash, and a message replies to the message that has most of the
words it quotes, of the lowest level that is found, the latest among equals. A message without linked quotation
replies to the message before it.

So the messages of a conversation are one tree of replies. ``thread`` is its root, the first message; ``position`` is a
message's place when the tree is read depth first, replies to one message in order of their turns, so that a message
is followed by all that answers it. ``branch`` is the message with which a run of plain answers begins: one that
answers something further up than the message before it, or the first. ``in_reply_order`` deals the result in that
order. The text that is returned has no quoted lines.

Scale: originals and quotations of a hash meet in a window ordered by turn, never as pairs, so a line that is said and
quoted a thousand times costs a sort. What comes before a message, its number and the head of its run are found
inside chunks of turns and then over the chunks. Only branches need more: their order is the ranking of a list (enter a
branch, leave it), by pointer doubling on the branches, each round a table in the shared folder.

Edge cases: null and empty texts have no lines; a null conv_id is a conversation; a null turn comes before all others
(position 0), replies to nothing and is never replied to; equal rows each get their own result row, rows of one turn count as one message for links;
quotations of unknown origin are removed all the same; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.quality_rules import let
from tidelog.llm.shared import drop_path, stored, work_dir

CHUNK_TURNS = 256
_MARKS = r"^(?:[ \t]*>)+[ \t]?"
_SPACE = "[\\x20\\x09-\\x0D]+"


def normal(text: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(text, _SPACE, " ")))


def levels(text: Column) -> Column:
    """The lines of a text as (at, level, body)."""
    marks = lambda x: F.regexp_extract(x, _MARKS, 0)
    line = lambda x, i: F.struct(i.alias("at"), F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), line)


def own_text(lines: Column) -> Column:
    return F.btrim(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n"), F.lit(" \t\n\x0b\x0c\r"))


def passages(lines: Column) -> Column:
    """Quoted passages as arrays of lines: one starts where the level is another than that of the line before."""

    def of_lines(all_: Column) -> Column:
        starts = F.filter(F.transform(all_, lambda x, i: F.when((i == 0) | (F.get(all_, i - 1)["level"] != x["level"]), i)), lambda i: i.isNotNull())
        cut = lambda s: F.transform(s, lambda i, k: F.slice(all_, i + 1, F.coalesce(F.get(s, k + 1), F.size(all_)) - i))
        return F.filter(let(starts, cut), lambda p: F.get(p, F.lit(0))["level"] > 0)

    return let(lines, of_lines)


def _hashed(text: Column) -> Column:
    return let(normal(text), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("words"), (x == "").alias("empty")))


def _units(whole: Column, parts: Column, level: Column) -> Column:
    every = F.concat(F.array(_hashed(whole)), F.transform(parts, _hashed))
    kept = F.array_distinct(F.filter(every, lambda u: ~u["empty"]))
    return F.transform(kept, lambda u: F.struct(level.alias("level"), u["h"].alias("h"), u["words"].alias("words")))


def _messages(chats: DataFrame) -> DataFrame:
    return chats.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, linked_words) for each message with a quotation whose origin is known."""
    own = F.filter("lines", lambda x: x["level"] == 0)
    said = _units(own_text(F.col("lines")), F.transform(own, lambda x: x["body"]), F.lit(0))
    quoted = F.flatten(F.transform(passages(F.filter("lines", lambda x: F.btrim(x["body"], F.lit(" \t\r")) != "")), lambda p: let(F.transform(p, lambda x: x["body"]), lambda bodies: _units(F.array_join(bodies, " "), bodies, F.get(p, F.lit(0))["level"]))))
    quotes = messages.where(F.exists("lines", lambda x: x["level"] > 0))
    asked = quotes.select("conv", "turn", F.explode(quoted).alias("u")).select("conv", "turn", "u.*")
    # only hashes that are quoted in the conversation matter
    wanted = asked.select(F.col("conv").alias("conv_"), F.col("h").alias("h_")).distinct()
    told = messages.select("conv", "turn", F.explode(said).alias("u")).select("conv", "turn", "u.*")
    told = told.join(wanted, (F.col("h") == F.col("h_")) & F.col("conv").eqNullSafe(F.col("conv_")), "left_semi")
    both = asked.unionByName(told).where("turn is not null").groupBy("conv", "h", "turn", "level").agg(F.max("words").alias("words"))
    before = Window.partitionBy("conv", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("origin", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(before)).where("level > 0 and origin is not null")
    votes = found.groupBy("conv", "turn", "level", "origin").agg(F.sum("words").alias("words"))
    best = F.struct((-F.col("level")).alias("level"), F.col("words"), F.col("origin"))
    return votes.groupBy("conv", "turn").agg(F.max(best).alias("best")).select("conv", "turn", F.col("best.origin").alias("reply_to"), F.col("best.words").alias("linked_words"))


def _same(*names: str) -> Column:
    """Equality with the columns of the same names and an underscore behind; null is a conversation."""
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(n + "_")) if n == "conv" else F.col(n) == F.col(n + "_") for n in names])


def _marked(table: DataFrame, *names: str) -> DataFrame:
    return table.withColumnsRenamed({n: n + "_" for n in names})


def previous_turns(messages: DataFrame) -> DataFrame:
    """(conv, turn, chunk, before): the turn before each distinct turn of a conversation."""
    turns = messages.where("turn is not null").select("conv", "turn").distinct().withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS))
    inside = turns.withColumn("inner", F.lag("turn").over(Window.partitionBy("conv", "chunk").orderBy("turn")))
    ends = turns.groupBy("conv", "chunk").agg(F.max("turn").alias("end"))
    ends = ends.withColumn("outer", F.lag("end").over(Window.partitionBy("conv").orderBy("chunk")))
    joined = inside.join(_marked(ends, "conv", "chunk"), _same("chunk", "conv"))
    return joined.select("conv", "turn", "chunk", F.coalesce("inner", "outer").alias("before"))


def runs(before: DataFrame, linked: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, linked_words, thread, head, index): each turn's place in its run of plain answers."""
    link = _marked(linked, "conv", "turn").withColumnRenamed("reply_to", "link")
    facts = before.join(link, _same("turn", "conv"), "left").drop("conv_", "turn_")
    begins = F.col("before").isNull() | F.coalesce(F.col("link") != F.col("before"), F.lit(False))
    facts = facts.select("conv", "turn", "chunk", F.coalesce("link", "before").alias("reply_to"), "linked_words", begins.alias("begins"))
    order = Window.partitionBy("conv", "chunk").orderBy("turn")
    inner = facts.withColumn("n", F.row_number().over(order).cast("long"))
    own = F.when(F.col("begins"), F.struct("turn", "n"))
    inner = inner.withColumn("own", F.last(own, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = inner.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("size"), F.max(own).alias("last"), F.min("turn").alias("least"))
    so_far = Window.partitionBy("conv").orderBy("chunk")
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    head = F.when(F.col("last").isNotNull(), F.struct(F.col("last.turn").alias("turn"), (F.col("base") + F.col("last.n")).alias("n")))
    chunks = chunks.select("conv", "chunk", "base", F.last(head, True).over(earlier).alias("outer"), F.first("least").over(so_far).alias("thread"))
    joined = inner.join(_marked(chunks, "conv", "chunk"), _same("chunk", "conv"))
    index = F.col("base") + F.col("n") - F.coalesce(F.col("base") + F.col("own.n"), F.col("outer.n"))
    return joined.select("conv", "turn", "reply_to", "linked_words", "thread", F.coalesce("own.turn", "outer.turn").alias("head"), index.alias("index"))


def branch_starts(placed: DataFrame, folder: str) -> DataFrame:
    """(conv, head, start): how many messages come before each run of a conversation with branches, depth first."""
    heads = placed.where("turn = head and reply_to is not null").select("conv", "head", F.col("reply_to").alias("turn"))
    parents = _marked(placed.select("conv", "turn", F.col("head").alias("parent"), F.col("index").alias("at")), "conv", "turn")
    kids = stored(heads.join(parents, _same("turn", "conv")).select("conv", "head", "parent", "at", F.floor(F.col("head") / CHUNK_TURNS).alias("chunk")), f"{folder}/branches")
    several = kids.select("conv").distinct()
    size = placed.groupBy("conv", "head").agg(F.count(F.lit(1)).alias("size")).join(_marked(several, "conv"), _same("conv"), "left_semi")
    # what answers a later message of a run comes first, then by turn
    near = Window.partitionBy("conv", "parent", "at", "chunk").orderBy("head")
    groups = kids.groupBy("conv", "parent", "at", "chunk").agg(F.min("head").alias("first"))
    groups = groups.withColumn("after", F.lead("first").over(Window.partitionBy("conv", "parent").orderBy(F.desc("at"), "chunk")))
    keys = ("conv", "parent", "at", "chunk")
    kin = kids.withColumn("near", F.lead("head").over(near)).join(_marked(groups, *keys), _same(*keys))
    kin = kin.select("conv", "head", "parent", F.coalesce("near", "after").alias("sibling"))
    eldest = kids.groupBy("conv", F.col("parent").alias("head")).agg(F.min(F.struct((-F.col("at")).alias("at"), "head")).alias("eldest")).select("conv", "head", F.col("eldest.head").alias("child"))
    known = size.join(_marked(kin, "conv", "head"), _same("head", "conv"), "left").drop("conv_", "head_")
    known = known.join(_marked(eldest, "conv", "head"), _same("head", "conv"), "left").drop("conv_", "head_")
    enter, leave = F.lit(0), F.lit(1)
    nodes = F.array(
        F.struct(enter.alias("side"), F.col("size").alias("n"), F.coalesce("child", "head").alias("to"), F.when(F.col("child").isNull(), leave).otherwise(enter).alias("to_side")),
        F.struct(leave.alias("side"), F.lit(0).cast("long").alias("n"), F.coalesce("sibling", "parent").alias("to"), F.when(F.col("sibling").isNull(), leave).otherwise(enter).alias("to_side")),
    )
    now = stored(known.select("conv", "head", F.explode(nodes).alias("x")).select("conv", "head", "x.*"), f"{folder}/0")
    k = 0
    while now.where("`to` is not null").limit(1).count():
        k += 1
        far = now.select(*[F.col(c).alias("far_" + c) for c in now.columns])
        met = F.col("conv").eqNullSafe(F.col("far_conv")) & (F.col("to") == F.col("far_head")) & (F.col("to_side") == F.col("far_side"))
        hop = now.join(far, met, "left").select("conv", "head", "side", (F.col("n") + F.coalesce("far_n", F.lit(0))).alias("n"), F.col("far_to").alias("to"), F.col("far_to_side").alias("to_side"))
        now = stored(hop, f"{folder}/{k}")
        drop_path(now.sparkSession, f"{folder}/{k - 1}")
    left = now.where("side = 0").select("conv", "head", "n")
    whole = left.groupBy("conv").agg(F.max("n").alias("whole"))
    return left.join(_marked(whole, "conv"), _same("conv")).select("conv", "head", (F.col("whole") - F.col("n")).alias("start"))


def linked_conversations(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, quote_levels, quoted_lines, reply_to, linked_words, thread, branch, position, text (without quotes), formatted."""
    messages = _messages(chats)
    folder = work_dir(chats.sparkSession, "quotes")
    lines = levels(F.col("text")).alias("lines")
    found = stored(links(messages.select("conv", "turn", lines)), f"{folder}/links")
    placed = stored(runs(previous_turns(messages), found), f"{folder}/runs")
    starts = _marked(branch_starts(placed, folder), "conv", "head")
    facts = placed.join(starts, _same("head", "conv"), "left")
    facts = facts.select(F.col("conv").alias("conv_"), F.col("turn").alias("turn_"), "reply_to", "linked_words", "thread", F.col("head").alias("branch"), (F.coalesce("start", F.lit(0)) + F.col("index") + 1).alias("position"))
    joined = messages.join(facts, _same("turn", "conv"), "left").select("*", lines)
    text = own_text(F.col("lines"))
    return joined.select(
        F.col("conv").alias("conv_id"), "turn", "role",
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("quote_levels"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("quoted_lines"),
        "reply_to",
        F.coalesce("linked_words", F.lit(0)).cast("long").alias("linked_words"),
        "thread", "branch",
        F.coalesce("position", F.lit(0)).cast("long").alias("position"),
        text.alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), text, F.lit("\n")).alias("formatted"),
    )


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Linked conversations dealt and sorted so that each is read as its replies go, a long one over several partitions."""
    return linked.repartitionByRange("conv_id", "position", "turn").sortWithinPartitions("conv_id", "position", "turn")

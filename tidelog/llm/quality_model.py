"""Operator 1: a quality classifier, a generalised additive model with pairwise interactions.

Features of a text are counts and ratios over its bytes, words and lines, taken by numpy kernels from whole Arrow
batches. Each feature is cut into bins at quantiles of the training sample. Cyclic boosting adds to one feature's
lookup table at a time the leaves of a shallow tree that is fitted to the residuals, round after round in a fixed
order; then the pairs whose 2-D tables lower the loss most are boosted likewise, with trees of one cut on each side.
A score is the logistic of the sum of one bin's value from each table, added up by array indexing.

Scale: one pass over the texts writes a row of about a hundred bytes for each document; labels are joined to those
rows, never to texts. The model learns on the driver from at most ``SAMPLE_ROWS`` labelled rows, those with the lowest
hash of their id, so its cost has a bound; every document is scored. Tables take a few kilobytes in the task.

Edge cases: null and empty texts have zero for all features and get the score those earn; labels that are null or
repeated are left out or count once each; without labels of both kinds every score is the share of label 1 (or 0.5);
repeated rows and ids each get their own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import crc_mod, give_back, lowest, slices, small_batches, stored, whole_rows, word_bounds, word_hashes, work_dir

SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
BINS = 32
PAIR_BINS = 8
ROUNDS = 60
PAIR_ROUNDS = 20
PAIRS = 10
RATE = 0.25
LEAVES_DEPTH = 2
#: Fewest rows of a leaf.
LEAF_ROWS = 8

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "exclaim", "pipe", "punct", "wide", "control",
    "short_words", "long_words", "lone_symbols", "distinct_words", "top_word", "repeats", "repeats_long", "line_words",
    "dup_lines", "noisy_ends", "upper_words",
)


def _class(members: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members.encode())] = True
    return found


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_SYMBOL = _class("#*$%&<>|@^~_=+\\{}[]")
_PUNCT = _class(".,;:?'\"()-/")
_LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: distinct keys, keys that occur twice or more (all occurrences), and the most of one key."""
    distinct, repeated, most = (np.zeros(n_rows, np.int64) for _ in range(3))
    if len(keys):
        salted = keys ^ (rows.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        order = np.argsort(salted)
        salted, owner = salted[order], rows[order]
        begin = np.flatnonzero(np.concatenate(([True], salted[1:] != salted[:-1])))
        size = np.diff(np.append(begin, len(salted)))
        owner = owner[begin]
        distinct += np.bincount(owner, minlength=n_rows)
        repeated += np.bincount(owner, weights=np.where(size > 1, size, 0), minlength=n_rows).astype(np.int64)
        np.maximum.at(most, owner, size)
    return distinct, repeated, most


def features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A float32 row of FEATURES for each row of a text buffer."""
    n_rows = len(at) - 1
    size = np.diff(at)
    starts, ends, first = word_bounds(buf, at)
    words = np.diff(first)
    some, some_words = np.maximum(size, 1), np.maximum(words, 1)
    row_of = np.repeat(np.arange(n_rows), words)
    length = ends - starts
    by_word = lambda flags: np.bincount(row_of, weights=flags, minlength=n_rows) / some_words
    of_class = lambda table: _per_row(table[buf], at) / some
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTER[buf], out=letters[1:])
    upper = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_UPPER[buf], out=upper[1:])
    hashes = word_hashes(buf, starts, ends)
    distinct, _, most = _repeats(hashes, row_of, n_rows)
    window = 5
    fits = np.arange(len(hashes)) + window <= np.repeat(first[1:], words) if len(hashes) else np.zeros(0, bool)
    chained = np.zeros(len(hashes), np.uint64)
    for k in range(window):
        chained = chained * np.uint64(0xC2B2AE3D27D4EB4F)
        chained[: max(0, len(hashes) - k)] += hashes[k:]
    _, repeated, _ = _repeats(chained[fits], row_of[fits], n_rows)
    # lines, cut at line breaks and at the ends of rows
    breaks = np.unique(np.concatenate((np.flatnonzero(buf == 10) + 1, at)))
    left, right = breaks[:-1], breaks[1:]
    line_row = np.searchsorted(at, left, "right") - 1
    filled = np.searchsorted(starts, right) > np.searchsorted(starts, left)
    left, right, line_row = left[filled], right[filled] - (buf[right[filled] - 1] == 10), line_row[filled]
    lines = np.maximum(np.bincount(line_row, minlength=n_rows), 1)
    _, dup_lines, _ = _repeats(word_hashes(buf, left, right), line_row, n_rows)
    tail = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    word_letters, word_upper = letters[ends] - letters[starts], upper[ends] - upper[starts]
    columns = {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(words),
        "word_bytes": np.bincount(row_of, weights=length, minlength=n_rows) / some_words,
        "upper": of_class(_UPPER),
        "digit": of_class(_DIGIT),
        "symbol": of_class(_SYMBOL),
        "exclaim": of_class(_class("!")),
        "pipe": of_class(_class("|")),
        "punct": of_class(_PUNCT),
        "wide": _per_row(buf >= 128, at) / some,
        "control": _per_row((buf < 32) & (buf != 10), at) / some,
        "short_words": by_word(length <= 3),
        "long_words": by_word(length > 14),
        "lone_symbols": by_word(word_letters == 0),
        "distinct_words": distinct / some_words,
        "top_word": most / some_words,
        "repeats": repeated / some_words,
        "repeats_long": np.log1p(repeated),
        "line_words": np.log1p(words / lines),
        "dup_lines": dup_lines / lines,
        "noisy_ends": by_word(_SYMBOL[tail] | (tail == 33)),
        "upper_words": by_word((word_upper == word_letters) & (word_letters > 1)),
    }
    return np.stack([columns[name] for name in FEATURES], axis=1).astype(np.float32)


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, x): the features of every document as an array of floats."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(buf, at) for _, _, buf, at in slices(batch.column(2), 1 << 20)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(x)], ["doc_id", "text_hash", "x"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, x array<float>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


# ---- the model -----------------------------------------------------------------------------------------------


@dataclass
class AdditiveModel:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: (feature, feature, cuts, cuts, 2-D table)
    pairs: list[tuple] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cuts, x[:, j], "right")]
        for i, j, ci, cj, values in self.pairs:
            total += values[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins).astype(np.float32)) if len(x) else np.zeros(0, np.float32)


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """A Newton step for each bin from a tree over ordered bins with sums of gradient, weight and rows in each."""
    step = np.zeros(len(gradient))

    def grow(a: int, b: int, depth: int) -> None:
        g, w = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
        n = np.cumsum(rows[a:b])
        if depth and b - a > 1:
            gain = g[:-1] ** 2 / (w[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1) - g[-1] ** 2 / (w[-1] + 1)
            gain[(n[:-1] < LEAF_ROWS) | (n[-1] - n[:-1] < LEAF_ROWS)] = 0
            cut = int(np.argmax(gain))
            if gain[cut] > 1e-6:
                grow(a, a + cut + 1, depth - 1)
                grow(a + cut + 1, b, depth - 1)
                return
        step[a:b] = g[-1] / (w[-1] + 1)

    grow(0, len(gradient), depth)
    return step


def crossed_tree(g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each side over a 2-D table of sums: its steps and its gain."""
    G, W = g.cumsum(0).cumsum(1), w.cumsum(0).cumsum(1)
    total = [(G[:-1, :-1], W[:-1, :-1])]
    total.append((G[:-1, -1:] - G[:-1, :-1], W[:-1, -1:] - W[:-1, :-1]))
    total.append((G[-1:, :-1] - G[:-1, :-1], W[-1:, :-1] - W[:-1, :-1]))
    total.append((G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + G[:-1, :-1], W[-1, -1] - W[:-1, -1:] - W[-1:, :-1] + W[:-1, :-1]))
    gain = sum(a**2 / (b + 1) for a, b in total) - G[-1, -1] ** 2 / (W[-1, -1] + 1)
    step = np.zeros_like(g)
    if not gain.size:
        return step, 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [float(a[i, j] / (b[i, j] + 1)) for a, b in total]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = leaf
    return step, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of one feature at a time, then of the best pairs; deterministic."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    n_features = x.shape[1]
    model.cuts = [quantile_cuts(x[:, j], BINS) for j in range(n_features)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    raw = np.full(len(y), model.base)
    logistic = lambda: 1 / (1 + np.exp(-raw))
    for _ in range(ROUNDS):
        for j in range(n_features):
            p = logistic()
            g = np.bincount(bins[j], weights=y - p, minlength=len(rows[j]))
            w = np.bincount(bins[j], weights=p * (1 - p), minlength=len(rows[j]))
            step = RATE * np.clip(shallow_tree(g, w, rows[j], LEAVES_DEPTH), -4, 4)
            model.tables[j] += step
            raw += step[bins[j]]
    cuts = [quantile_cuts(x[:, j], PAIR_BINS) for j in range(n_features)]
    few = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]

    def sums(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(cuts[i]) + 1, len(cuts[j]) + 1)
        flat = few[i] * shape[1] + few[j]
        return tuple(np.bincount(flat, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    p = logistic()
    gains = sorted(((crossed_tree(*sums(i, j, p))[1], i, j) for i in range(n_features) for j in range(i)), reverse=True)
    chosen = [(i, j, np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in chosen:
            step = RATE * np.clip(crossed_tree(*sums(i, j, logistic()))[0], -4, 4)
            values += step
            raw += step[few[i], few[j]]
    model.pairs = [(i, j, cuts[i], cuts[j], values) for i, j, values in chosen]
    return model


def labelled_sample(known: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, x, y) of at most ``limit`` labelled rows outside the held-out fold, those of the lowest id hash."""
    y = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id_")).agg(F.max(F.col(label).cast("double")).alias("y"))
    joined = known.where(crc_mod(F.col("doc_id"), folds) != held_out).join(y, F.col("doc_id") == F.col("doc_id_")).drop("doc_id_")
    return lowest(joined.withColumn("hash", F.xxhash64("doc_id")), "hash", limit, "doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash (of the row, for joining back)."""
    folder = work_dir(docs.sparkSession, "quality")
    known = stored(with_features(docs), f"{folder}/features")
    rows = labelled_sample(known, labels, "quality", FOLDS, HELD_OUT, SAMPLE_ROWS).select("x", "y").toArrow()
    x = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in rows["x"].chunks)]).reshape(-1, len(FEATURES))
    model = fit(x, (rows["y"].to_numpy() > 0).astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten(), np.float32).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], ["doc_id", "text_hash", "score"])

    scored = known.mapInArrow(run, "doc_id long, text_hash long, score double")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "text_hash")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted as good, each by its own text; the columns of ``docs``."""
    good = quality_scores(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("good_id"), F.col("text_hash").alias("good_hash")).distinct()
    rows = whole_rows(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "hash": F.xxhash64("row.text")})
    return rows.join(good, (F.col("hash") == F.col("good_hash")) & F.col("id").eqNullSafe(F.col("good_id")), "left_semi").select("row.*")

"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its learned hashed embedding, the mean of the learned embeddings of its character 4- and 5-grams, and
three evidence values: smoothed log-odds of the word and the highest and mean log-odds of its character grams among
the training documents. Two gated recurrent layers read a window of ``WINDOW`` words, one from each end; attention
pools their states and a logistic unit scores the window. All windows of a text are scored, each overlapping half of
the next, and the text's score is that of its worst window.

Labels belong to documents, so training picks windows: at first those with most evidence, then, after a first fit,
those that score highest (for clean documents these are the hardest negatives). Gradients are exact back-propagation
through time; steps follow Adam with a fixed seed.

Scale: the network trains on the driver on at most ``SAMPLE_DOCS`` documents of each label, those of the lowest id hash;
their ids (a bounded list) are broadcast to find their texts. Of a text over ``SAMPLE_BYTES`` bytes it sees excerpts of
``EXCERPT_WORDS`` words that are spread evenly over the whole text. Every whole text is scored in one pass without a
shuffle, distinct words of a slice once, windows in blocks of bounded memory.

Edge cases: null and empty texts are one empty window; labels that are null are left out, repeated ones count once
(toxic if any is); without labels of both kinds every score is the smoothed share of label 1; repeated rows and ids
each get their own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import LOWER, crc_mod, lowest, slices, small_batches, word_bounds, word_hashes

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 12_000
EXCERPT_WORDS = 96
WINDOW, STRIDE = 32, 16
HIDDEN = 8
EMBED = 4
ODDS_BITS, EMBED_BITS = 17, 13
GRAMS = (4, 5)
#: Steps of each turn of training, over as many rounds of the chosen windows as that takes.
STEPS = (130, 130)
BATCH = 256
RATE = 0.01
#: Windows that are scored at once.
BLOCK = 8_192
_GRAM = np.uint64(0x9E3779B97F4A7C15)
_EVIDENCE = 3
INPUT = _EVIDENCE + 2 * EMBED
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"'()[]{}*#$%&|<>-_")] = True


class Words:
    """The distinct words of a text buffer and which of them stands at each place."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.buf = LOWER[buf]
        starts, ends, self.first = word_bounds(buf, at)
        if len(starts):  # punctuation around a word is no part of it
            for _ in range(3):
                long = ends - starts > 1
                starts = starts + (long & _PUNCT[self.buf[starts]])
                long = ends - starts > 1
                ends = ends - (long & _PUNCT[self.buf[ends - 1]])
        self.hashes, where, self.index = np.unique(word_hashes(self.buf, starts, ends), return_index=True, return_inverse=True)
        self.starts, self.ends = starts[where], ends[where]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the character grams of the distinct words and the word of each; a word's start counts as one."""
        hashes, owners = [], []
        size = self.ends - self.starts
        for n in GRAMS:
            n_grams = np.maximum(size + 1 - n + 1, 1)
            owner = np.repeat(np.arange(len(size)), n_grams)
            offset = np.arange(int(n_grams.sum())) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
            value = np.full(len(owner), n, np.uint64)
            for k in range(n):
                place = offset + k - 1  # -1 is the start mark
                inside = (place >= 0) & (place < size[owner])
                byte = np.where(inside, self.buf[np.minimum(self.starts[owner] + np.maximum(place, 0), len(self.buf) - 1)] + 2, np.where(place < 0, 1, 0))
                value = (value + byte.astype(np.uint64)) * _GRAM
                value ^= value >> np.uint64(29)
            hashes.append(value)
            owners.append(owner)
        return np.concatenate(hashes), np.concatenate(owners)


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - bits)).astype(np.int64)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (word indexes) of all windows, and the row of each; a row without words has one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + step * STRIDE
    return start, np.minimum(start + WINDOW, first[row + 1]), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes. A window is a row of word indexes (0: nothing there) with a mask."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.word_odds = np.zeros(1 << ODDS_BITS, np.float32)
        self.gram_odds = np.zeros(1 << ODDS_BITS, np.float32)
        self.base = 0.5
        self.trained = False
        self.p = {"word": 0.1 * rng.standard_normal((1 << EMBED_BITS, EMBED)).astype(np.float32), "gram": 0.1 * rng.standard_normal((1 << EMBED_BITS, EMBED)).astype(np.float32), "att": normal(2 * HIDDEN, HIDDEN), "key": normal(HIDDEN, 1), "out": normal(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": normal(INPUT, 3 * HIDDEN), f"U{side}": normal(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}

    # inputs

    def inputs(self, words: Words) -> tuple[np.ndarray, tuple]:
        """The input vector of each distinct word, after a row of zeros, and what the backward pass needs."""
        n = len(words.hashes)
        x = np.zeros((n + 1, INPUT), np.float32)
        if not n:
            return x, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(0))
        grams, owner = words.grams()
        size = np.bincount(owner, minlength=n)
        odds = self.gram_odds[bucket(grams, ODDS_BITS)]
        x[1:, 0] = self.word_odds[bucket(words.hashes, ODDS_BITS)]
        top = np.full(n, -9, np.float32)
        np.maximum.at(top, owner, odds)
        x[1:, 1] = top
        x[1:, 2] = np.bincount(owner, weights=odds, minlength=n) / size
        word_at, gram_at = bucket(words.hashes, EMBED_BITS), bucket(grams, EMBED_BITS)
        x[1:, _EVIDENCE : _EVIDENCE + EMBED] = self.p["word"][word_at]
        for k in range(EMBED):
            x[1:, _EVIDENCE + EMBED + k] = np.bincount(owner, weights=self.p["gram"][gram_at, k], minlength=n) / size
        return x, (word_at, gram_at, owner, size)

    # forward

    def _gru(self, pre: np.ndarray, index: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        U = self.p["U" + side]
        h = np.zeros((len(index), HIDDEN), np.float32)
        states = np.zeros((WINDOW, len(index), HIDDEN), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            a, m = pre[index[:, t]], mask[:, t, None]
            hu = h @ U
            gates = _sigmoid(a[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = h + m * z * (c - h)
            if keep is not None:
                keep.append((t, h, hu[:, 2 * HIDDEN :], z, r, c))
            h = states[t] = new
        return states

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        pre = {s: x @ self.p["W" + s] + self.p["c" + s] for s in "fb"}
        steps = {s: ([] if keep is not None else None) for s in "fb"}
        states = np.concatenate([self._gru(pre[s], index, mask, s, steps[s]) for s in "fb"], axis=2)
        u = np.tanh(states @ self.p["att"])
        e = (u @ self.p["key"])[:, :, 0].T - 30 * (1 - mask)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        weight = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,tnd->nd", weight, states)
        logit = (pooled @ self.p["out"])[:, 0] + self.p["bias"][0]
        if keep is not None:
            keep |= {"steps": steps, "states": states, "u": u, "weight": weight, "pooled": pooled, "x": x, "index": index, "mask": mask}
        return logit

    # backward

    def backward(self, keep: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of the input vectors."""
        p, states, u, weight = self.p, keep["states"], keep["u"], keep["weight"]
        index, mask, x = keep["index"], keep["mask"], keep["x"]
        grad = {"out": keep["pooled"].T @ d_logit[:, None], "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"][:, 0]
        d_states = weight.T[:, :, None] * d_pooled[None]
        d_weight = np.einsum("nd,tnd->nt", d_pooled, states)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        d_u = d_e.T[:, :, None] * p["key"][:, 0] * (1 - u * u)
        grad["key"] = np.einsum("tnh,nt->h", u, d_e)[:, None]
        grad["att"] = np.einsum("tnd,tnh->dh", states, d_u)
        d_states = d_states + d_u @ p["att"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            own, U = d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN], p["U" + side]
            d_h = np.zeros((len(index), HIDDEN), np.float32)
            d_U, d_pre = np.zeros_like(U), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, hu_c, z, r, c in reversed(keep["steps"][side]):
                d_h = d_h + own[t]
                m = mask[:, t, None]
                d_z, d_c = d_h * m * (c - h) * z * (1 - z), d_h * m * z * (1 - c * c)
                d_r = d_c * hu_c * r * (1 - r)
                d_hu = np.concatenate((d_z, d_r, d_c * r), axis=1)
                d_U += h.T @ d_hu
                np.add.at(d_pre, index[:, t], np.concatenate((d_z, d_r, d_c), axis=1))
                d_h = d_h * (1 - m * z) + d_hu @ U.T
            grad["U" + side], grad["c" + side], grad["W" + side] = d_U, d_pre.sum(axis=0), x.T @ d_pre
            d_x += d_pre @ p["W" + side].T
        return grad, d_x

    # scoring

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The logit and the row of every window of a text buffer."""
        x, _ = self.inputs(words)
        start, end, row = windows_of(words.first)
        out = np.empty(len(start), np.float32)
        for i in range(0, len(start), BLOCK):
            index, mask = window_index(words.index, start[i : i + BLOCK], end[i : i + BLOCK])
            out[i : i + BLOCK] = self.forward(x, index, mask)
        return out, row

    def scores(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(at) - 1, self.base)
        words = Words(buf, at)
        logit, row = self.window_logits(words)
        top = np.full(len(at) - 1, -np.inf)
        np.maximum.at(top, row, logit)
        return 1 / (1 + np.exp(-np.clip(top, -30, 30)))


def window_index(index: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = start[:, None] + np.arange(WINDOW)
    inside = place < end[:, None]
    if not len(index):
        return np.zeros(place.shape, np.int64), inside.astype(np.float32)
    return np.where(inside, index[np.minimum(place, len(index) - 1)] + 1, 0), inside.astype(np.float32)


def evidence_of(buf: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log-odds by bucket, of words and of character grams, from the documents in which they occur."""
    seen = np.zeros((2, 2, 1 << ODDS_BITS), np.int64)  # words or grams, label, bucket
    for row in range(0, len(y), 64):
        end = min(row + 64, len(y))
        words = Words(buf[at[row] : at[end]], at[row : end + 1] - at[row])
        pairs = np.unique(words.index * 64 + np.repeat(np.arange(end - row), np.diff(words.first)))
        word, owner = pairs // 64, pairs % 64
        grams, of_word = words.grams()
        order = np.argsort(of_word, kind="stable")
        begin = np.searchsorted(of_word[order], np.arange(len(words.hashes) + 1))
        size = np.diff(begin)[word]
        which = order[np.repeat(begin[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        for k, (at_bucket, rows) in enumerate(((bucket(words.hashes, ODDS_BITS)[word], owner), (bucket(grams, ODDS_BITS)[which], np.repeat(owner, size)))):
            both = np.unique(at_bucket * 64 + rows)
            toxic = y[row + both % 64] > 0
            for label in (0, 1):
                np.add.at(seen[k, label], both[toxic == bool(label)] // 64, 1)
    total = np.array([(y == 0).sum(), (y > 0).sum()])
    value = np.log((seen[:, 1] + 0.5) / (total[1] + 1)) - np.log((seen[:, 0] + 0.5) / (total[0] + 1))
    n = seen.sum(axis=1)
    return tuple(np.clip(value * n / (n + 3), -3, 5).astype(np.float32))


def train(buf: np.ndarray, at: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """A network from labelled texts (y: 1 toxic)."""
    net = Network(seed)
    net.base = float((y.sum() + 1) / (len(y) + 2))
    if len(np.unique(y)) < 2:
        return net
    rng = np.random.default_rng(seed)
    words = Words(buf, at)
    net.word_odds, net.gram_odds = evidence_of(buf, at, y)
    net.trained = True
    start, end, row = windows_of(words.first)
    moments: dict[str, tuple] = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    tick = 0
    for turn, steps in enumerate(STEPS):
        x, _ = net.inputs(words)
        if turn == 0:
            evidence = np.concatenate(([0.0], np.cumsum(np.maximum(x[words.index + 1, :2].max(axis=1), 0) ** 2)))
            rank = evidence[end] - evidence[np.minimum(start, end)]
        else:
            rank, _ = net.window_logits(words)
        best = np.lexsort((-rank, row))
        best = best[np.concatenate(([True], row[best][1:] != row[best][:-1]))]
        clean = np.flatnonzero(y[row] == 0)
        chosen = np.concatenate((best, rng.choice(clean, min(len(clean), len(best)), replace=False)))
        target = y[row[chosen]].astype(np.float32)
        gain = np.where(target > 0, (target == 0).sum() / max(1, target.sum()), 1.0) ** 0.5
        for _ in range(-(-steps * BATCH // max(BATCH, len(chosen)))):
            shuffled = rng.permutation(len(chosen))
            for i in range(0, len(chosen), BATCH):
                pick = shuffled[i : i + BATCH]
                index, mask = window_index(words.index, start[chosen[pick]], end[chosen[pick]])
                used, local = np.unique(index, return_inverse=True)
                some = _Subset(words, used[used > 0] - 1)
                x, (word_at, gram_at, owner, size) = net.inputs(some)
                keep: dict = {}
                logit = net.forward(x, local.reshape(index.shape) + (0 if used[0] == 0 else 1), mask, keep)
                d = ((_sigmoid(logit) - target[pick]) * gain[pick] / len(pick)).astype(np.float32)
                grad, d_x = net.backward(keep, d)
                grad["word"], grad["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
                np.add.at(grad["word"], word_at, d_x[1:, _EVIDENCE : _EVIDENCE + EMBED])
                np.add.at(grad["gram"], gram_at, (d_x[1:, _EVIDENCE + EMBED :] / size[:, None])[owner])
                tick += 1
                for name, g in grad.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[name] -= (RATE * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)).astype(np.float32)
    return net


class _Subset(Words):
    """Some of the distinct words of a buffer."""

    def __init__(self, words: Words, chosen: np.ndarray):
        self.buf, self.hashes, self.starts, self.ends = words.buf, words.hashes[chosen], words.starts[chosen], words.ends[chosen]


def excerpt(text: str, most: int) -> str:
    """A text of at most ``most`` bytes whole, else excerpts of it in its order, as many as make about that many bytes."""
    buf = np.frombuffer(text.encode(), np.uint8)
    if len(buf) <= most:
        return text
    starts, ends, _ = word_bounds(buf, np.array([0, len(buf)]))
    if not len(starts):
        return ""
    first = np.arange(0, len(starts), EXCERPT_WORDS)
    begin, stop = starts[first], ends[np.minimum(first + EXCERPT_WORDS, len(starts)) - 1]
    n = max(1, int(most / np.mean(stop - begin)))
    picked = np.unique(np.linspace(0, len(first) - 1, min(n, len(first))).astype(int))
    parts = [buf[a : min(b, a + most)].tobytes().decode("utf-8", "ignore") for a, b in zip(begin[picked], stop[picked], strict=True)]
    return " ".join(parts)[:most]


def training_texts(docs: DataFrame, labels: DataFrame) -> pa.Table:
    """(text, y) of the training sample."""
    y = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id_")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    y = y.where(crc_mod(F.col("doc_id_"), FOLDS) != HELD_OUT)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    y = y.join(texts.select("doc_id"), F.col("doc_id") == F.col("doc_id_"), "left_semi")
    y = y.withColumn("hash", F.xxhash64("doc_id_"))
    few = [lowest(y.where(F.col("y") == k), "hash", SAMPLE_DOCS, "doc_id_").drop("hash") for k in (0, 1)]
    joined = texts.join(F.broadcast(few[0].union(few[1])), F.col("doc_id") == F.col("doc_id_"))
    most = SAMPLE_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([excerpt(x, most) for x in batch.column(1).to_pylist()], pa.string()), batch.column(2)], ["doc_id", "text", "y"])

    short = joined.select("doc_id", "text", "y").mapInArrow(cut, "doc_id long, text string, y int")
    once = short.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").toArrow()


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    from tidelog.llm.shared import text_buffer

    small_batches(docs.sparkSession)
    sample = training_texts(docs, labels)
    net = train(*text_buffer(sample["text"]), sample["y"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [net.scores(buf, at) for _, _, buf, at in slices(batch.column(1), 1 << 20)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

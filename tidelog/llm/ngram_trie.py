"""Operator 7: a 3-gram language model in an Elias-Fano trie, trained on the corpus and queried where texts are.

Level 1 holds the words (64-bit hashes) in order; a word's rank is its id. Level 2 holds, for each word as a context,
its successors in order of id; level 3 the successors of each 2-gram. As every word that follows (u, v) also follows
v, a level-3 successor is coded by its position among the successors of v, found by the same successor search. Each
level is monotone and stored as Elias-Fano sequences, and so are the pointers from contexts to their first successor.
With an n-gram goes its discounted probability, with a context the weight of the lower order, both quantised to 16
bits of their logarithm::

    p1(w) = (c(w) + 1) / (N + V + 1)
    p2(w | v) = a(v w) + g(v) p1(w),        a = (c(v w) - D) / c(v),       g(v) = 1 - sum of a(v .)
    p3(w | u v) = a(u v w) + g(u v) p2(w | v)

All n-grams are kept (``LEAST_COUNT`` 1; a higher one leaves rare ones to the lower order, and their mass to g). Contexts
unseen are left to the lower order. A text's first token has the end of a text as its context. A look-up finds the
context and its pointer, then searches among the context's successors only.

Training is three passes over the training texts. A task counts keys in chunks in numpy and sends sorted, compressed
blocks to the bucket of their key range; a bucket adds up its blocks and writes one segment of a level into the shared
folder. So no count, word or n-gram comes to the driver; it sees one row for each segment, with points of the words'
mass whose number has a bound for all segments together. Ranges follow the mass of
words, and a word that holds much of the mass has its successors in many ranges. Segments are memory-mapped by the
workers (read whole where the store cannot map).

Edge cases: null and empty texts are one end token; words of any length count; repeated rows train and score as rows
of their own; with no training text every probability is that of an unknown token; a null id trains and is not held
out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import LOWER, arrow_fs, crc_mod, replace, slices, small_batches, word_bounds, word_hashes, work_dir

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
LEAST_COUNT = 1
#: Keys that a task counts at once, bytes of text for each segment, bytes of text that a task looks at in one go.
CHUNK_KEYS = 3_000_000
SEGMENT_BYTES = 16 << 20
GROUP_BYTES = 4 << 20
#: Partitions of segments; beyond that many segments a partition has several, one after another.
MOST_PARTITIONS = 20_000
#: Points of level 1's cumulative mass that shape the ranges of level 2: for a segment, and for all at most.
POINTS, MOST_POINTS = 32, 2_000_000
END = np.uint64(0x5AFE5AFE00000001)
_U = np.uint64


_FIVES, _THREES, _FIFTEENS, _BYTES, _TOPS = (_U(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
#: Position of the k-th set bit of a byte, at 8 x byte + k.
_NTH_OF_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.int64)


# ---- Elias-Fano ----------------------------------------------------------------------------------------------


class EliasFano:
    """A sorted sequence of distinct or repeated integers: packed low bits, and unary high bits with a directory."""

    def __init__(self, parts: dict[str, np.ndarray], name: str = ""):
        self.n, self.low_bits = (int(x) for x in parts[f"{name}n"])
        self.low, self.high, self.ones = (parts[f"{name}{k}"] for k in ("low", "high", "ones"))
        self.zeros = (np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones).astype(self.ones.dtype)
        # a word that starts at any byte
        self.low_at = np.ndarray((max(len(self.low) - 7, 0),), ">u8", self.low, strides=(1,))

    @staticmethod
    def parts(values: np.ndarray, name: str = "") -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(0, (top // n).bit_length() - 1)) if n else 0
        low = values & _U((1 << bits) - 1)
        packed = [np.unpackbits(low[i : i + 100_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - bits :].ravel() for i in range(0, n, 100_000)] if bits else []
        packed = np.packbits(np.concatenate(packed)) if packed else np.zeros(0, np.uint8)
        high = (values >> _U(bits)).astype(np.int64)
        size = (int(high[-1]) if n else 0) + n + 2
        words = np.zeros(-(-size // 64) * 64, np.uint8)
        words[high + np.arange(n)] = 1
        words = np.packbits(words, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        return {f"{name}n": np.array([n, bits]), f"{name}low": np.concatenate((packed, np.zeros(8, np.uint8))), f"{name}high": words, f"{name}ones": ones.astype("<u4" if len(words) < 1 << 26 else "<i8")}

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        return (self.low_at[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)) >> _U(64 - self.low_bits)

    @staticmethod
    def _nth(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit of each word: its byte from running sums of the bytes' bits, then a table."""
        sums = word - ((word >> _U(1)) & _FIVES)
        sums = (sums & _THREES) + ((sums >> _U(2)) & _THREES)
        sums = ((sums + (sums >> _U(4))) & _FIFTEENS) * _BYTES
        k = k.astype(np.uint64)
        byte = np.bitwise_count(((k * _BYTES | _TOPS) - sums) & _TOPS).astype(np.uint64) << _U(3)
        k -= ((sums << _U(8)) >> byte) & _U(255)
        return byte.astype(np.int64) + _NTH_OF_BYTE[(((word >> byte) & _U(255)) << _U(3) | k).astype(np.int64)]

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(directory, k.astype(directory.dtype), "right") - 1
        bits = self.high[word]
        return word * 64 + self._nth(~bits if flip else bits, k - directory[word])

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high parts below the given ones."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        last = int(self.zeros[-1])
        k = np.minimum(high[some] - 1, last - 1)
        out[some] = np.minimum(self._select(k, self.zeros, True) - k, self.n)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        high = self._select(at, self.ones, False) - at
        return (high.astype(np.uint64) << _U(self.low_bits)) | self.lows(at)

    def get_two(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at positions and at the positions behind them."""
        bit = self._select(at, self.ones, False)
        rest = (self.high[bit >> 6] >> (bit & 63).astype(np.uint64)) >> _U(1)
        step = np.bitwise_count((rest & (~rest + _U(1))) - _U(1)).astype(np.int64) + 1
        far = np.flatnonzero(rest == 0)  # in another word
        after = bit + step
        after[far] = self._select(at[far] + 1, self.ones, False)
        shift = _U(self.low_bits)
        return ((bit - at).astype(np.uint64) << shift) | self.lows(at), ((after - at - 1).astype(np.uint64) << shift) | self.lows(at + 1)

    def run(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first value with each high part (or where it would stand), and how many there are."""
        begin = self.below(high)
        bit = begin + high  # after the zero that ends the part before
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        ended = ~(self.high[word] >> shift)
        size = np.bitwise_count((ended & (~ended + _U(1))) - _U(1)).astype(np.int64)
        over = np.flatnonzero(size >= 64 - (bit & 63))  # goes on in the next word
        size[over] = self.below(high[over] + 1) - begin[over]
        return begin, size

    def find(self, values: np.ndarray, least: np.ndarray | None = None, beyond: np.ndarray | None = None) -> np.ndarray:
        """The position of each value, or -1 (successor search inside the run of equal high parts).

        With ``least`` and ``beyond`` only between those positions.
        """
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = (values >> _U(self.low_bits)).astype(np.int64)
        top = int(self.zeros[-1])
        live = np.flatnonzero(high < top)
        begin, size = self.run(high[live])
        if least is not None:
            size = np.minimum(begin + size, beyond[live])
            begin = np.maximum(begin, least[live])
            size -= begin
        some = size > 0
        live, begin, end = live[some], begin[some], (begin + size)[some]
        want = values[live] & _U((1 << self.low_bits) - 1)
        stop = end.copy()
        while True:
            open_ = np.flatnonzero(end - begin > 1)  # the last value not above the wanted one
            if not len(open_):
                break
            middle = (begin[open_] + end[open_]) >> 1
            above = self.lows(middle) > want[open_]
            end[open_[above]] = middle[above]
            begin[open_[~above]] = middle[~above]
        hit = (begin < stop) & (self.lows(begin) == want)
        out[live[hit]] = begin[hit]
        return out


# ---- files ---------------------------------------------------------------------------------------------------


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file, each at a multiple of 64 bytes, under an attempt's name and then its own."""
    fs, path = arrow_fs(folder)
    fs.create_dir(path, recursive=True)
    heads, at = {}, 0
    for k, v in arrays.items():
        heads[k] = (v.dtype.str, len(v), at)
        at += -(-v.nbytes // 64) * 64
    head = json.dumps(heads).encode()
    head += b" " * (-(len(head) + 8) % 64)
    own = f"{path}/{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with fs.open_output_stream(own) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for v in arrays.values():
            out.write(np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 64))
    replace(fs, own, f"{path}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file as views of its memory map."""
    fs, path = arrow_fs(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        with fs.open_input_file(f"{path}/{name}") as f:
            whole = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(whole[:8].tobytes(), "little")
    base = 8 + size
    return {k: whole[base + at : base + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in json.loads(whole[8:base].tobytes()).items()}


def quantised(p: np.ndarray) -> np.ndarray:
    """16 bits of the logarithm of a probability, down to 1e-13."""
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-13)) * 5000), 0, 65535).astype(np.uint16)


def probability(q: np.ndarray) -> np.ndarray:
    return 10 ** (q.astype(np.float64) / -5000)


def small_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each, and the few of 255 and more aside."""
    large = np.flatnonzero(counts >= 255)
    return {"counts": np.minimum(counts, 255).astype(np.uint8), "large_at": large.astype("<i8"), "large": counts[large].astype("<u8")}


def counts_at(segment: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    found = segment["counts"][at].astype(np.int64)
    large = np.flatnonzero(found == 255)
    found[large] = segment["large"][np.searchsorted(segment["large_at"], at[large])]
    return found


# ---- counting ------------------------------------------------------------------------------------------------

_squeeze = zstandard.ZstdCompressor(level=1)


def block_of(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, compressed."""
    gap = np.diff(keys, prepend=_U(0))
    gap[0] = 0
    planes = gap.astype("<u8").view(np.uint8).reshape(-1, 8).T
    planes = np.ascontiguousarray(planes[: 8 if int(gap.max()) >> 32 else 4])
    head = np.array([len(keys), len(planes), int(keys[0])], "<u8").tobytes()
    return _squeeze.compress(head + planes.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes())


def of_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, width, first = np.frombuffer(data, "<u8", 3).tolist()
    planes = np.zeros((8, n), np.uint8)
    planes[:width] = np.frombuffer(data, np.uint8, width * n, 24).reshape(width, n)
    keys = np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64) + _U(first)
    counts = np.frombuffer(data, np.uint8, n, 24 + width * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", int((counts == 255).sum()), 24 + (width + 1) * n)
    return keys, counts


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begin], np.diff(np.append(begin, len(keys))) if counts is None else np.add.reduceat(counts, begin)


def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, where one of each stands, and which of them stands at each place."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], order[new], back


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all rows, each row with its end, and where each row starts (n + 1 values)."""
    lower = LOWER[buf]
    starts, ends, first = word_bounds(lower, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    begin = first + np.arange(len(first))
    found = np.full(int(begin[-1]), END, np.uint64)
    found[np.arange(len(starts)) + row] = word_hashes(lower, starts, ends)
    return found, begin


def count_level(docs: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], bounds: np.ndarray, write: Callable, columns: str) -> list:
    """Count the keys of texts by range and write a segment for each; the rows that ``write`` returns, by segment.

    ``bounds`` are the first keys of the ranges after the first; ``write(segment, keys, counts)`` gives a tuple.
    """
    n_ranges = len(bounds) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            keys, counts = counted(np.concatenate(waiting))
            waiting.clear()
            cut = np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[k], cut[k + 1]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([block_of(keys[a:b], counts[a:b])], pa.binary())], ["segment", "block"])

        for group in grouped(batches):
            waiting.append(keys_of(*tokens(*group)))
            if sum(map(len, waiting)) >= CHUNK_KEYS:
                yield from blocks()
        if waiting:
            yield from blocks()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, size = None, [], 0

        def row() -> pa.RecordBatch:
            found = write(now, *merged())
            own.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, *found)], ["segment", *names])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return counted(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))

        for batch in batches:
            for segment, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if segment != now and own:
                    yield row()
                    size = 0
                now = segment
                own.append(of_block(block.as_py()))
                size += len(own[-1][0])
                if size > 2 * CHUNK_KEYS:
                    own[:] = [merged()]
                    size = len(own[0][0]) // 2
        if own:
            yield row()

    names = [c.split()[0] for c in columns.split(", ")]
    blocks = docs.select("text").mapInArrow(count, "segment long, block binary")
    partitions = min(n_ranges, MOST_PARTITIONS)
    dealt = blocks.repartitionById(partitions, F.pmod(F.col("segment"), F.lit(partitions)).cast("int"))
    if n_ranges > partitions:
        dealt = dealt.sortWithinPartitions("segment")
    return sorted(dealt.mapInArrow(add, f"segment long, {columns}").collect(), key=lambda r: r["segment"])  # a row for each segment


def grouped(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for _, _, buf, at in slices(batch.column(column), GROUP_BYTES):
            yield buf, at


# ---- levels --------------------------------------------------------------------------------------------------


class Level:
    """A level's segments, opened when first needed: sorted keys by ranges, with the rows before each segment."""

    def __init__(self, folder: str, name: str, bounds: np.ndarray, rows: list):
        self.folder, self.name, self.bounds = folder, name, bounds
        self.size = np.zeros(len(bounds) + 1, np.int64)
        for r in rows:
            self.size[r["segment"]] = r["n"]
        self.base = np.concatenate(([0], np.cumsum(self.size)))
        self.open: dict[int, dict] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def __len__(self) -> int:
        return int(self.base[-1])

    def segment(self, k: int) -> dict:
        if k not in self.open:
            parts = load(self.folder, f"{self.name}-{k:06d}")
            self.open[k] = parts | {"keys": EliasFano(parts, "k_")} | ({"starts": EliasFano(parts, "s_")} if "s_n" in parts else {})
        return self.open[k]

    def _ranges(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cut = np.concatenate(([0], np.searchsorted(keys, self.bounds), [len(keys)]))
        for k in np.flatnonzero((np.diff(cut) > 0) & (self.size > 0)).tolist():
            yield k, int(cut[k]), int(cut[k + 1])

    def find(self, keys: np.ndarray, least: np.ndarray | None = None, beyond: np.ndarray | None = None) -> np.ndarray:
        """Positions of sorted keys in the whole level, or -1; with bounds only from ``least`` to before ``beyond``."""
        out = np.full(len(keys), -1, np.int64)
        for k, a, b in self._ranges(keys):
            bounds = () if least is None else (least[a:b] - self.base[k], beyond[a:b] - self.base[k])
            at = self.segment(k)["keys"].find(keys[a:b], *bounds)
            out[a:b] = np.where(at >= 0, at + self.base[k], -1)
        return out

    def take(self, at: np.ndarray, value: Callable[[dict, np.ndarray], np.ndarray]) -> np.ndarray:
        """Values at sorted positions, of a segment and positions in it."""
        cut = np.searchsorted(at, self.base)
        parts = [value(self.segment(k), at[cut[k] : cut[k + 1]] - self.base[k]) for k in np.flatnonzero(np.diff(cut)).tolist()]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def counts(self, at: np.ndarray) -> np.ndarray:
        return self.take(at, counts_at)


class Contexts(Level):
    """Level 2 or 3: n-grams as context x width + successor."""

    def __init__(self, folder: str, name: str, bounds: np.ndarray, rows: list, width: int):
        super().__init__(folder, name, bounds, rows)
        self.width = width
        self.first, self.last = np.zeros(len(self.size), np.int64), np.full(len(self.size), -1, np.int64)
        for r in rows:
            if r["n"]:
                self.first[r["segment"]], self.last[r["segment"]] = r["first"], r["last"]
        edge: dict[int, list] = {}  # contexts at the edges of segments may go on in the next
        for r in rows:
            if r["n"]:
                base = int(self.base[r["segment"]])
                ends = [(r["first"], r["first_mass"], 0, r["first_size"]), (r["last"], r["last_mass"], r["last_start"], r["n"])]
                for context, mass, start, end in ends[: 1 if r["first"] == r["last"] else 2]:
                    own = edge.setdefault(context, [base + start, 0.0, 0])
                    own[1] += mass
                    own[2] = base + end
        some = sorted(edge)
        self.edge = np.array(some, np.int64)
        self.edge_start = np.array([edge[c][0] for c in some], np.int64)
        self.edge_end = np.array([edge[c][2] for c in some], np.int64)
        self.edge_weight = np.array([max(1 - edge[c][1], 1e-12) for c in some])

    def of_context(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First position, position behind the last, and weight of the lower order, for sorted contexts.

        A context without successors has the weight 1, and two equal positions.
        """
        start, end, weight = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64), np.ones(len(contexts))
        keys = contexts.astype(np.uint64) * _U(self.width)
        for k, a, b in self._ranges(keys):
            seg, own = self.segment(k), contexts[a:b]
            hit = np.flatnonzero((own >= self.first[k]) & (own <= self.last[k]))
            at = own[hit] - self.first[k]
            one, two = seg["starts"].get_two(at)
            start[a + hit], end[a + hit] = one.astype(np.int64) + self.base[k], two.astype(np.int64) + self.base[k]
            weight[a + hit] = probability(seg["weight"][at])
        if len(self.edge):
            at = np.minimum(np.searchsorted(self.edge, contexts), len(self.edge) - 1)
            hit = self.edge[at] == contexts
            start[hit], end[hit], weight[hit] = self.edge_start[at[hit]], self.edge_end[at[hit]], self.edge_weight[at[hit]]
        return start, end, weight


CONTEXT_COLUMNS = "n long, first long, first_mass double, first_size long, last long, last_mass double, last_start long, most long"


def write_contexts(folder: str, name: str, segment: int, keys: np.ndarray, counts: np.ndarray, width: int, total_of: Callable[[np.ndarray], np.ndarray], keep_counts: bool) -> tuple:
    """Write the n-grams of a range; total_of gives the counts of sorted contexts."""
    if LEAST_COUNT > 1:
        keep = counts >= LEAST_COUNT
        keys, counts = keys[keep], counts[keep]
    if not len(keys):
        return 0, 0, 0.0, 0, 0, 0.0, 0, 0
    context = (keys // _U(width)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    own, size = context[begin], np.diff(np.append(begin, len(keys)))
    p = (counts - DISCOUNT) / np.repeat(total_of(own), size)
    mass = np.add.reduceat(p, begin)
    # a pointer for every context from the first to the last: those without successors have that of the next
    place = np.arange(own[0], own[-1] + 2)
    starts = np.append(begin, len(keys))[np.searchsorted(own, place)]
    weight = np.zeros(len(place) - 1, np.uint16)
    weight[own - own[0]] = quantised(np.maximum(1 - mass, 1e-12))
    arrays = EliasFano.parts(keys, "k_") | EliasFano.parts(starts.astype(np.uint64), "s_")
    save(folder, f"{name}-{segment:06d}", arrays | {"p": quantised(p), "weight": weight} | (small_counts(counts) if keep_counts else {}))
    return len(keys), int(own[0]), float(mass[0]), int(size[0]), int(own[-1]), float(mass[-1]), int(begin[-1]), int(size.max())


class Model:
    """The three levels and what a token's probability takes from them."""

    def __init__(self, words: Level, n_tokens: int):
        self.words, self.n_tokens = words, n_tokens
        self.pairs: Contexts | None = None
        self.triples: Contexts | None = None

    @property
    def n_words(self) -> int:
        return len(self.words)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of the known distinct tokens in order, each token's place among them or -1, and that of the end."""
        distinct, _, back = distinct_of(hashes)
        found = self.words.find(distinct)
        there = found >= 0
        place = np.where(there, np.cumsum(there) - 1, -1)
        end = np.searchsorted(distinct, END)
        return found[there], place[back], int(place[end]) if end < len(distinct) and distinct[end] == END else -1

    def pair_keys(self, ids: np.ndarray, place: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token's context (a place or -1), the tokens that are known after a known one, and the keys of their 2-grams."""
        before = np.concatenate(([end], place[:-1]))
        both = np.flatnonzero((place >= 0) & (before >= 0))
        return before, both, ids[before[both]].astype(np.uint64) * _U(self.n_words) + ids[place[both]].astype(np.uint64)

    def located(self, ids: np.ndarray, place: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each token's distinct 2-gram or -1 and the weight of its lower order; the 2-grams' positions in level 2 (or
        -1), and their places among the successors of their context."""
        start, stop, weight = self.pairs.of_context(ids)
        before, both, keys = self.pair_keys(ids, place, end)
        distinct, first, back = distinct_of(keys)
        context = before[both[first]]
        at = self.pairs.find(distinct, start[context], stop[context])
        pair = np.full(len(place), -1, np.int64)
        pair[both] = np.where(at >= 0, np.arange(len(at)), -1)[back]
        return pair, np.append(weight, 1.0)[before], at, at - start[context]

    def triple_keys(self, first: np.ndarray, pair: np.ndarray, at: np.ndarray, relative: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token's context (a distinct 2-gram or -1), the tokens that have a 2-gram after another, and the keys of
        their 3-grams: the context's position, and the successor's place among those of the shorter context."""
        before = np.concatenate(([-1], pair[:-1]))
        before[first[:-1]] = -1  # no 3-gram reaches into the text before
        whole = np.flatnonzero((pair >= 0) & (before >= 0))
        return before, whole, at[before[whole]].astype(np.uint64) * _U(self.triples.width) + relative[pair[whole]].astype(np.uint64)

    def scores(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each row."""
        hashes, first = tokens(buf, at)
        ids, place, end = self.known(hashes)
        base = (np.append(self.words.counts(ids), 0)[place] + 1) / (self.n_tokens + self.n_words + 1)
        p = base
        if self.pairs is not None and len(self.pairs):
            pair, weight, spot, relative = self.located(ids, place, end)
            p = weight * base + self._p(self.pairs, spot)[pair]
            if self.triples is not None and len(self.triples):
                before, whole, keys = self.triple_keys(first, pair, spot, relative)
                there = spot >= 0
                start, stop, weight = self.triples.of_context(spot[there])
                context = np.where(there, np.cumsum(there) - 1, -1)
                p = np.append(weight, 1.0)[np.append(context, -1)[before]] * p
                distinct, at_first, back = distinct_of(keys)
                own = context[before[whole[at_first]]]
                found = self.triples.find(distinct, start[own], stop[own])
                p[whole] += self._p(self.triples, found)[back]
        add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)  # noqa: E731  no row is without its end
        return np.diff(first), add((place >= 0).astype(np.int64)), add(np.log10(base)), add(np.log10(np.minimum(p, 1.0)))

    @staticmethod
    def _p(level: Contexts, at: np.ndarray) -> np.ndarray:
        """Probabilities at sorted positions, 0 where there is none, and a 0 behind them all."""
        out = np.zeros(len(at) + 1)
        hit = np.flatnonzero(at >= 0)
        out[hit] = probability(level.take(at[hit], lambda segment, at: segment["p"][at]))
        return out


_models: dict[str, Model] = {}


def opened(key: str, model: Model) -> Model:
    """The worker's own copy of a model, which keeps its segments open."""
    if key not in _models:
        _models.clear()
        _models[key] = model
    return _models[key]


# ---- training ------------------------------------------------------------------------------------------------


def pair_bounds(rows: list, n_words: int, bases: np.ndarray, n_ranges: int) -> np.ndarray:
    """Ranges of 2-gram keys with about equal mass of their first word; one word may span several."""
    keys, masses, done = [0.0], [0.0], 0
    for r in rows:
        points = [bases[r["segment"]] + p for p in r["points"]]
        for j, p in enumerate(points):
            run = points.count(p)
            keys.append((p + (points[: j + 1].count(p)) / run) * n_words)
            masses.append(done + r["tokens"] * (j + 1) / len(points))
        done += r["tokens"]
    wanted = np.arange(1, n_ranges) * (done / n_ranges)
    return np.unique(np.interp(wanted, masses, np.maximum.accumulate(keys)).astype(np.uint64))


def train(docs: DataFrame, folder: str) -> Model:
    """Train on a table with a text column; the levels are written below ``folder``."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, math.ceil(size / SEGMENT_BYTES))
    n_points = max(1, min(POINTS, MOST_POINTS // n_ranges))

    def write_words(segment: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
        save(folder, f"words-{segment:06d}", EliasFano.parts(keys, "k_") | small_counts(counts))
        mass = np.cumsum(counts)
        points = np.searchsorted(mass, mass[-1] * np.arange(1, n_points + 1) / n_points).tolist()
        return len(keys), int(mass[-1]), points

    bounds = np.array([(k << 64) // n_ranges for k in range(1, n_ranges)], np.uint64)
    rows = count_level(docs, lambda hashes, first: hashes, bounds, write_words, "n long, tokens long, points array<long>")
    model = Model(Level(folder, "words", bounds, rows), sum(r["tokens"] for r in rows))
    if not rows:
        return model
    key = f"{folder}/1"

    def pair_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        own = opened(key, model)
        return own.pair_keys(*own.known(hashes))[2]

    bounds = pair_bounds(rows, model.n_words, model.words.base, n_ranges)
    rows = count_level(docs, pair_keys, bounds, lambda s, k, c: write_contexts(folder, "pairs", s, k, c, model.n_words, lambda own: opened(key, model).words.counts(own), True), CONTEXT_COLUMNS)
    second = Model(model.words, model.n_tokens)
    second.pairs = Contexts(folder, "pairs", bounds, rows, model.n_words)
    if not len(second.pairs):
        return second
    # the successors of a word that spans segments: at most those of all segments it touches
    most = max(r["most"] for r in rows)
    for context in {r[c] for r in rows if r["n"] for c in ("first", "last")}:
        touched = [r["n"] for r in rows if r["n"] and r["first"] <= context <= r["last"]]
        most = max(most, sum(touched))
    width = 1 << most.bit_length()
    n_pairs = len(second.pairs)
    bounds = np.unique(np.array([k * n_pairs // n_ranges * width for k in range(1, n_ranges)], np.uint64))
    second.triples = Contexts(folder, "none", np.zeros(0, np.uint64), [], width)
    key_2 = f"{folder}/2"

    def triple_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        own = opened(key_2, second)
        pair, _, at, relative = own.located(*own.known(hashes))
        return own.triple_keys(first, pair, at, relative)[2]

    rows = count_level(docs, triple_keys, bounds, lambda s, k, c: write_contexts(folder, "triples", s, k, c, width, lambda own: opened(key_2, second).pairs.counts(own), False), CONTEXT_COLUMNS)
    third = Model(second.words, second.n_tokens)
    third.pairs, third.triples = second.pairs, Contexts(folder, "triples", bounds, rows, width)
    return third


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    folder = work_dir(docs.sparkSession, "ngrams")
    model = train(own.where(~held_out), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(f"{folder}/3", model)
        for batch in batches:
            parts = [known.scores(buf, at) for buf, at in grouped([batch], 1)]
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = own.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")

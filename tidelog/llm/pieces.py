"""Operator 2: encoding into SentencePiece pieces and back, with the N best segmentations.

A text becomes U+2581 plus itself with each space as U+2581. The piece lattice has an edge for every vocabulary piece
at every place, with the piece's score in the model; a character that no piece holds is an edge with the lowest score
less 10 and becomes its UTF-8 bytes. No piece but runs of U+2581 holds one inside, so every path passes the places
before a run of U+2581 and the lattice falls into units. A unit falls into parts wherever no piece holds the two
characters that meet there; each part is solved once per worker, and a unit is its parts in a row.

Forward Viterbi scores of a unit are exact heuristics for the search from its end: A-star takes the partial path whose
score plus the best score of what is left is highest, so complete paths come out in order. A text's N best differ from
its best in units with the N - 1 smallest losses only (each alone gives a segmentation no worse than any that leaves
the best elsewhere), so the search over a text expands those units and keeps the others at their best. Which units
these are follows from forward and backward scores: the second best path is the best one through an edge that the
best path lacks.

Order: higher score first; the best path of a unit takes the longest last piece among equals.

Scale: no shuffle; whole texts, in groups of about ``GROUP_BYTES`` (or one text that has more); new parts of a group are
solved together by numpy over padded arrays of bounded size, very long parts one by one in linear time and memory, as
the search keeps no more than N partial paths, which share their ends. A worker forgets its units when it knows
``CACHE_UNITS``, and its parts when it knows ``CACHE_PARTS``.

Edge cases: null and empty texts have no pieces, score 0 and one segmentation; a U+2581 in the text itself is written
as its bytes, so decoding gives every text back; repeated rows each get their own row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import give_back, small_batches, spans, text_buffer, text_groups

N_BEST = 4
SPACE = "▁"
PENALTY = 10.0
CACHE_UNITS = 200_000
CACHE_PARTS = 300_000
CACHE_LISTS = 20_000
#: Parts longer than this are solved alone; cells of the padded arrays (parts x places x piece lengths).
LONG_UNIT = 40
CELLS = 300_000
#: Bytes of texts that are encoded together.
GROUP_BYTES = 1 << 20
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Lattice:
    """A model's pieces and the best segmentations of units."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.score_of = [model.get_score(i) for i in range(n)]
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = min(self.score_of[i] for i in plain if self.score_of[i] > -1e8) - PENALTY
        self.longest = max(map(len, self.id_of))
        self.bytes_of = [b""] * n
        for text, i in self.id_of.items():
            self.bytes_of[i] = text.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])
        self.bytes_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.bytes_at = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes_of])))
        self._hash_pieces()
        self._mark_inner()
        self.parts = Solved()
        self.units = Solved()
        self.listed: dict[tuple[str, int], list] = {}

    # where a unit may be cut

    INNER_BITS = 20

    def _mark_inner(self) -> None:
        """The pairs of characters that stand together inside a piece, by hash; a collision only leaves out a cut."""
        self.inner = np.zeros(1 << self.INNER_BITS, bool)
        flat = np.frombuffer("".join(self.id_of).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in self.id_of])
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        at = np.flatnonzero(inside)
        self.inner[self._pairs(flat[at], flat[at + 1])] = True

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        both = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        return (self._finish(both * self.BASE) >> np.uint64(64 - self.INNER_BITS)).astype(np.int64)

    def cut(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of units that are not empty, and how many each has."""
        whole = "".join(units)
        flat = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum([0, *map(len, units)])
        begins = np.ones(len(flat), bool)
        begins[1:] = ~self.inner[self._pairs(flat[:-1], flat[1:])]
        begins[first[:-1]] = True
        at = np.append(np.flatnonzero(begins), len(flat))
        return [whole[a:b] for a, b in pairwise(at.tolist())], np.diff(np.searchsorted(at, first))

    # piece lookup by hashed substrings

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 19

    def _hash_pieces(self) -> None:
        """Buckets of up to 8 pieces by the hash of their code points."""
        texts = list(self.id_of)
        values = np.array([self._hash(t) for t in texts], np.uint64)
        slot = (self._finish(values) >> np.uint64(64 - self.BITS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        depth = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order])
        self.depth = int(depth.max()) + 1
        self.key = np.zeros((self.depth, 1 << self.BITS), np.uint64)
        self.piece = np.full((self.depth, 1 << self.BITS), -1, np.int32)
        self.key[depth, slot[order]] = values[order]
        self.piece[depth, slot[order]] = np.array(list(self.id_of.values()), np.int32)[order]
        self.scores = np.array(self.score_of)

    @classmethod
    def _hash(cls, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(cls.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _finish(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        slot = (self._finish(h) >> np.uint64(64 - self.BITS)).astype(np.int64)
        found = np.full(h.shape, -1, np.int32)
        for d in range(self.depth):
            hit = self.key[d][slot] == h
            found = np.where(hit, self.piece[d][slot], found)
        return found

    # many units at once

    def _solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units in a row, their numbers, scores and losses of the second best; units are columns."""
        n, width = len(units), max(map(len, units))
        size = np.fromiter(map(len, units), np.int64, n)
        column = np.arange(n)
        chars = np.zeros((width, n), np.uint64)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(column, size)
        chars[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), owner] = flat
        deep = min(self.longest, width)
        edge, piece = [], []  # for each length of a piece: score and id of the one that starts at each place
        h = np.zeros((width, n), np.uint64)
        place = np.arange(width)[:, None]
        for k in range(deep):
            h = h[: width - k] * self.BASE + chars[k:] + np.uint64(1)
            found = self._lookup(h)
            found[place[: width - k] + k >= size] = -1
            score = np.where(found >= 0, self.scores[found], self.unknown if k == 0 else -np.inf)
            edge.append(score)
            piece.append(found)
        edge[0][place >= size] = -np.inf
        ahead = np.full((width + 1, n), -np.inf)
        ahead[0] = 0
        back = np.zeros((width + 1, n), np.int64)
        for e in range(1, width + 1):
            best, pick = ahead[e], back[e]
            for k in range(min(deep, e), 0, -1):
                cand = ahead[e - k] + edge[k - 1][e - k]
                better = cand > best
                best[better] = cand[better]
                pick[better] = k
        rest = np.full((width + 1, n), -np.inf)
        rest[size, column] = 0
        for i in range(width - 1, -1, -1):
            for k in range(1, min(deep, width - i) + 1):
                np.maximum(rest[i], edge[k - 1][i] + rest[i + k], out=rest[i])
        total = ahead[size, column]
        chosen = np.full((width, n), -2, np.int32)
        at, live = size.copy(), column
        while len(live):
            k = back[at[live], live]
            start = at[live] - k
            for step in np.unique(k):
                own, begin = live[k == step], start[k == step]
                chosen[begin, own] = piece[step - 1][begin, own]
                edge[step - 1][begin, own] = -np.inf  # what is left are the edges that the best path lacks
            at[live] = start
            live = live[start > 0]
        second = np.full(n, -np.inf)
        for k in range(deep):
            np.maximum(second, (ahead[: width - k] + edge[k] + rest[k + 1 :]).max(axis=0), out=second)
        there = chosen.T > -2
        ids, number = chosen.T[there], there.sum(axis=1)
        lone = np.flatnonzero(ids < 0)
        if len(lone):  # characters without a piece become their bytes
            unit_of, place_of = np.nonzero(there)
            coded = [[self.byte_id[b] for b in units[unit_of[k]][place_of[k]].encode()] for k in lone.tolist()]
            spread = np.ones(len(ids), np.int64)
            spread[lone] = [len(c) for c in coded]
            number = np.bincount(unit_of, weights=spread, minlength=n).astype(np.int64)
            ids = np.repeat(ids, spread)
            ids[ids < 0] = np.concatenate(coded)
        return ids, number, total, total - second

    def _spelled(self, unit: str, pieces: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Piece ids with bytes for characters without a piece."""
        if not len(pieces) or pieces.min() >= 0:
            return pieces
        out: list[int] = []
        for p, at in zip(pieces.tolist(), places.tolist(), strict=True):
            out += [p] if p >= 0 else [self.byte_id[b] for b in unit[at].encode()]
        return np.array(out, np.int32)

    # one unit

    def edges_to(self, unit: str, e: int) -> list[tuple[int, int, float]]:
        """The edges that end at a place: (start, piece or -1, score), the longest first."""
        found = []
        for i in range(max(0, e - self.longest), e):
            p = self.id_of.get(unit[i:e])
            if p is not None:
                found.append((i, p, self.score_of[p]))
        if not found or found[-1][0] < e - 1:
            found.append((e - 1, -1, self.unknown))
        return found

    def _ahead(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """Forward Viterbi: the best score of every place, and where the last piece of that begins (the longest among equals)."""
        ahead, back = np.zeros(len(unit) + 1), np.zeros(len(unit) + 1, np.int64)
        for e in range(1, len(unit) + 1):
            best, pick = -np.inf, 0
            for i, _, s in self.edges_to(unit, e):
                if ahead[i] + s > best:
                    best, pick = ahead[i] + s, i
            ahead[e], back[e] = best, pick
        return ahead, back

    def alone(self, unit: str) -> tuple[np.ndarray, float, float]:
        """Ids, score and loss of the second best path of a very long part, in linear time and memory."""
        ahead, back = self._ahead(unit)
        rest = np.full(len(unit) + 1, -np.inf)
        rest[len(unit)] = 0
        used, other, path = len(unit), -np.inf, None
        for e in range(len(unit), 0, -1):
            for i, p, s in self.edges_to(unit, e):
                rest[i] = max(rest[i], s + rest[e])
                if e == used and i == back[e]:
                    path = (i, p, path)
                else:
                    other = max(other, ahead[i] + s + rest[e])
            if e == used:
                used = back[e]
        return self._path(unit, path), float(ahead[-1]), float(ahead[-1] - other)

    def best_of(self, unit: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a unit: backward A-star, exact by its forward Viterbi scores.

        An entry's value is the score of the best path that ends as it does, and no two entries share a path, so an
        entry behind n better ones leads to none of the n best and is let go. Paths share their ends.
        """
        ahead, _ = self._ahead(unit)
        order, out = 0, []
        front: list[tuple] = [(-ahead[-1], 0, len(unit), 0.0, None)]
        while front and len(out) < n:
            _, _, place, done, path = front.pop(0)
            if place == 0:
                out.append((done, self._path(unit, path)))
                continue
            for i, p, s in self.edges_to(unit, place):
                order += 1
                front.append((-(ahead[i] + done + s), order, i, done + s, (i, p, path)))
            front = sorted(front, key=lambda x: x[:2])[: n - len(out)]
        return out

    def _path(self, unit: str, path: tuple | None) -> np.ndarray:
        pieces, places = [], []
        while path is not None:
            at, piece, path = path
            places.append(at)
            pieces.append(piece)
        return self._spelled(unit, np.array(pieces, np.int32), np.array(places, np.int64))

    # texts

    def units_of(self, text: str) -> list[str]:
        """Units of a text; the empty unit stands for a U+2581 of its own."""
        out: list[str] = []
        for k, part in enumerate(text.split(SPACE)):
            out += ([""] if k else []) + _UNITS.findall((SPACE if k == 0 else "") + part.replace(" ", SPACE))
        return out

    @staticmethod
    def unit_of(key: str) -> str:
        """The unit of a key: a word follows a U+2581, a line break goes without, a space marks a unit as it is."""
        return key[1:] if key[:1] == " " else key if key[:1] == "\n" else SPACE + key

    def keys_of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The keys of the units of all texts, and where each text's begin (n + 1 values)."""
        texts = texts.fill_null("")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        keys, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        begin, size = at[:-1] - at[0], np.diff(at)
        odd_key = np.flatnonzero(pc.equal(keys, "").to_numpy(zero_copy_only=False))
        odd = np.union1d(np.searchsorted(begin, odd_key, "right") - 1, np.flatnonzero(pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False)))
        if len(odd):  # spaces that stand together or at an end, or a U+2581
            cut = [[" " + u for u in self.units_of(x)] if x else [] for x in texts.take(pa.array(odd)).to_pylist()]
            size[odd] = [len(x) for x in cut]
            begin[odd] = len(keys) + np.cumsum(size[odd]) - size[odd]
            keys = pa.concat_arrays([keys, pa.array(list(chain.from_iterable(cut)), keys.type)])
            keys = keys.take(pa.array(spans(begin, size)))
        return keys, np.concatenate(([0], np.cumsum(size)))

    def numbered(self, keys: list[str]) -> np.ndarray:
        """The numbers of units by their keys, each there once; new ones are solved."""
        number = self.units.number
        found = list(map(number.get, keys))
        if None in found:
            new = [k for k, n in zip(keys, found, strict=True) if n is None]
            if len(number) + len(new) > CACHE_UNITS:
                self.units = Solved()
                number, new = self.units.number, keys
            self.learn(new)
            found = list(map(number.__getitem__, keys))
        return np.array(found, np.int64)

    def learn(self, keys: list[str]) -> None:
        """Units that are new, from their parts."""
        literal = np.array([self.byte_id[b] for b in SPACE.encode()], np.int32)
        if " " in keys:  # the empty unit stands for a U+2581 of the text's own
            self.units.add([" "], literal, np.array([3]), np.array([3 * self.unknown]), np.array([np.inf]))
            keys = [k for k in keys if k != " "]
        if not keys:
            return
        parts, size = self.cut(list(map(self.unit_of, keys)))
        number = self.parts.number
        new = set(parts).difference(number)
        if len(number) + len(new) > CACHE_PARTS:
            self.parts = Solved()
            number, new = self.parts.number, set(parts)
        if new:
            self.solve_parts(sorted(new, key=len))
        own = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        first = np.cumsum(size) - size
        n_ids = self.parts.size(own)
        self.units.add(keys, self.parts.ids(own), np.add.reduceat(n_ids, first), np.add.reduceat(self.parts.score[own], first), np.minimum.reduceat(self.parts.gap[own], first))

    def solve_parts(self, parts: list[str]) -> None:
        """Solve parts, the shortest first, in classes of like length."""
        found: list[list] = [[], [], [], []]
        done = 0
        while done < len(parts):
            width = len(parts[done])
            if width > LONG_UNIT:
                ids, score, gap = self.alone(parts[done])
                solved, end = (ids, [len(ids)], [score], [gap]), done + 1
            else:
                most = max(1, CELLS // (min(width + 2, LONG_UNIT) * min(self.longest, width + 2)))
                end = done + 1
                while end < len(parts) and end - done < most and len(parts[end]) <= min(width + 2, LONG_UNIT):
                    end += 1
                solved = self._solve(parts[done:end])
            for whole, own in zip(found, solved, strict=True):
                whole.append(own)
            done = end
        self.parts.add(parts, *map(np.concatenate, found))

    def segmentations(self, numbers: np.ndarray, key_at: Callable[[int], str], n: int) -> list[tuple[float, dict[int, np.ndarray]]]:
        """The n best of a text: score, and the ids of the places whose unit is not at its best."""
        total = float(self.units.score[numbers].sum())
        if n == 1:
            return [(total, {})]
        loss = self.units.gap[numbers]
        few = np.argsort(loss, kind="stable")[: n - 1] if len(loss) < 64 else self._least(loss, n - 1)
        few = sorted(int(k) for k in few if np.isfinite(loss[k]))
        options = []
        for k in few:
            unit = self.unit_of(key_at(k))
            if (ways := self.listed.get((unit, n))) is None:
                ways = self.best_of(unit, n)
                if len(unit) <= LONG_UNIT:
                    if len(self.listed) >= CACHE_LISTS:
                        self.listed.clear()
                    self.listed[unit, n] = ways
            options.append(ways)
        # backward A-star over the chain of chosen units: the score of what is left at its best is exact
        out: list[tuple[float, dict]] = []
        heap: list[tuple] = [(-total, 0, len(few), ())]
        order = 0
        while heap and len(out) < n:
            value, _, left, path = heapq.heappop(heap)
            if left == 0:
                out.append((-value, {few[k]: options[k][c][1] for k, c in enumerate(path) if c}))
                continue
            for c, (s, _) in enumerate(options[left - 1]):
                order += 1
                heapq.heappush(heap, (value + options[left - 1][0][0] - s, order, left - 1, (c, *path)))
        return out

    @staticmethod
    def _least(loss: np.ndarray, n: int) -> np.ndarray:
        part = np.argpartition(loss, n)[:n]
        worst = loss[part].max()
        sure = np.flatnonzero(loss < worst)
        return np.concatenate((sure, np.flatnonzero(loss == worst)[: n - len(sure)]))

    def encode_columns(self, texts: pa.Array, n: int = N_BEST) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, np.ndarray]]]]:
        """The ids of all texts' best in a row, where each text's begin (n + 1 values), and each text's n best."""
        keys, rows = self.keys_of(texts)
        coded = keys.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = coded.indices.to_numpy()
        numbers = self.numbered(distinct)[which]
        ids = self.units.ids(numbers)
        ends = np.concatenate(([0], np.cumsum(self.units.size(numbers))))
        out = []
        for a, b in pairwise(rows.tolist()):
            best, edge = ids[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            ways = []
            for value, other in self.segmentations(numbers[a:b], lambda k: distinct[which[a + k]], n):  # noqa: B023  used at once
                parts, at = [], 0
                for k in sorted(other):
                    parts += [best[at : edge[k]], other[k]]
                    at = edge[k + 1]
                ways.append((value, np.concatenate([*parts, best[at:]]) if other else best))
            out.append(ways)
        return ids, ends[rows], out

    def encode(self, texts: list[str | None], n: int = N_BEST) -> list[list[tuple[float, np.ndarray]]]:
        """For each text its n best segmentations as (score, ids), the best first."""
        return self.encode_columns(pa.array(texts, pa.string()), n)[2]

    def spelled_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes of ids: pieces joined, bytes as they are, a U+2581 as a space."""
        return self.bytes_flat[spans(self.bytes_at[ids], self.bytes_at[ids + 1] - self.bytes_at[ids])]

    def same(self, ids: np.ndarray, rows: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Whether the ids of each text, from ``rows`` on, decode to it."""
        size = np.concatenate(([0], np.cumsum(self.bytes_at[ids + 1] - self.bytes_at[ids])))[rows]
        found = self.spelled_bytes(ids)
        buf, at = text_buffer(texts)
        out = np.zeros(len(rows) - 1, bool)
        for k, ((a, b), (c, d)) in enumerate(zip(pairwise(size.tolist()), pairwise(at.tolist()), strict=True)):
            begin = a + (b > a and found[a] == 32)  # the first space is not the text's
            out[k] = b - begin == d - c and np.array_equal(found[begin:b], buf[c:d])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the first space."""
        joined = self.spelled_bytes(np.asarray(ids, np.int64)).tobytes()
        return joined[joined[:1] == b" " :].decode("utf-8", "replace")


class Solved:
    """The best segmentations of numbered texts: ids in a row, scores, and losses of the second best."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.gap = np.zeros(0), np.zeros(0)

    def add(self, texts: list[str], ids: np.ndarray, size: np.ndarray, score: np.ndarray, gap: np.ndarray) -> None:
        begin = len(self.score)
        self.number.update(zip(texts, range(begin, begin + len(texts)), strict=True))
        self.flat = np.concatenate((self.flat, ids)).astype(np.int32)
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
        self.score, self.gap = np.concatenate((self.score, score)), np.concatenate((self.gap, gap))

    def size(self, numbers: np.ndarray) -> np.ndarray:
        return self.at[numbers + 1] - self.at[numbers]

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[spans(self.at[numbers], self.size(numbers))]


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def encoded(docs: DataFrame, model: str, n_best: int = N_BEST) -> DataFrame:
    """doc_id, ids (best), score, n_ways, last_score, ids_crc32 (u32), ways_crc32 (of all ways' ids), same (decoded)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lattice(model)
        for doc_ids, texts in text_groups(batches, GROUP_BYTES):
            ids, rows, ways = known.encode_columns(texts, n_best)
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids,
                    pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array([w[0][0] for w in ways], pa.float64()),
                    pa.array([len(w) for w in ways], pa.int64()),
                    pa.array([w[-1][0] for w in ways], pa.float64()),
                    pa.array([crc32_of(w[:1]) for w in ways], pa.int64()),
                    pa.array([crc32_of(w) for w in ways], pa.int64()),
                    pa.array(known.same(ids, rows, texts)),
                ],
                ["doc_id", "ids", "score", "n_ways", "last_score", "ids_crc32", "ways_crc32", "same"],
            )
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, score double, n_ways long, last_score double, ids_crc32 long, ways_crc32 long, same boolean")


def crc32_of(ways: list[tuple[float, np.ndarray]]) -> int:
    """The CRC-32 of the ids of all ways as little-endian unsigned 32-bit integers."""
    crc = 0
    for _, ids in ways:
        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"), crc)
    return crc

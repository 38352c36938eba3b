"""Operator 10: near-duplicates by SimHash with meet-in-the-middle ball hashing.

A fingerprint has a bit for each bit that is set in over half of the XXH64 values (seed 42) of the 3-word shingles.
Two fingerprints x and y within three bits have a variant z within half the radius of both (one bit from one, two
from the other), so every fingerprint emits its variants, these are shuffled by their hash, and those that collide are
compared. Two facts leave out variants that can find no further link:

* a pair that differs in 1 or 3 bits has one fingerprint of even and one of odd parity, so only odd fingerprints need
  variants at two bits, and even ones those at one bit (pairs at 2 bits, of one parity, meet at one bit from both);
* of any three differing bits two lie in the same half of the 64, so the odd fingerprint needs only the 992 two-bit
  variants within a half (by Mantel's theorem no smaller set of bit pairs meets every triple).

Variants are shuffled by one of their halves, in two tables. Most variants of a fingerprint flip bits of one half only,
so they share the other: they travel as one record and are spelled out where they meet, if another record has that
half too. In the table by right halves stand a fingerprint's variants at left bits (an odd one's at none, one and two)
and those at one right bit; the table by left halves has an odd fingerprint's variants at two right bits and an even
one's at one bit. A pair at two bits meets by its right halves; so does one at three of which two are left; one of
which two or more are right meets by its left halves. That is 34 records for an odd fingerprint and 66 for an even one.

All fingerprints at one variant that are one bit away from it link to all others there, so a star through one of them
keeps the components without all the pairs of a group; each link is verified on the fingerprints.

Scale: copies are counted once (one node for each distinct fingerprint). A task packs its records by bucket into blocks
of nine bytes a record, whatever the number of buckets: 450 bytes for a fingerprint. A bucket is sorted in numpy, its
variants are spelled out ``SPELLED`` at a time (a half that very many share in several turns) and it emits a spanning
forest of its verified links. Buckets grow in number with the fingerprints, never in size. Components run on tables
in the shared folder.

Edge cases: null and empty texts have fingerprint zero and link like any other; a text under three words is one
shingle; equal rows and repeated doc_ids each get their own result row; a null doc_id takes part but never names a
component that has another id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.shared import LOWER, give_back, slices, small_batches, spans, stored, whole_rows, word_bounds, work_dir

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that one task packs, records that one bucket holds on average, variants that are spelled out at once.
TASK_FPS = 60_000
BUCKET = 3_000_000
SPELLED = 3_000_000
#: Partitions of buckets; beyond that many buckets a partition has several, one after another.
MOST_PARTITIONS = 20_000


# ---- fingerprints --------------------------------------------------------------------------------------------


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words in lower case, one space after each, and where each now starts and ends."""
    size = ends - starts
    new_ends = np.cumsum(size + 1) - 1
    new_starts = new_ends - size
    out = np.full(int(new_ends[-1]) + 1 if len(size) else 0, 32, np.uint8)
    shift = np.repeat(new_starts - starts, size)
    at = np.arange(len(shift)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    out[at + shift] = LOWER[buf[at]]
    return out.tobytes(), new_starts, new_ends


def fingerprints(buf: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One u64 for each row of a text buffer."""
    import xxhash

    starts, ends, first = word_bounds(buf, at)
    text, new_starts, new_ends = joined_words(buf, starts, ends)
    counts = np.diff(first)
    found = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return found
    per_row = np.maximum(counts[rows] - shingle + 1, 1)
    begin = np.cumsum(per_row) - per_row
    left = np.repeat(first[:-1][rows] - begin, per_row) + np.arange(int(per_row.sum()))
    right = left + np.repeat(np.minimum(counts[rows], shingle) - 1, per_row)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(new_starts[left].tolist(), new_ends[right].tolist(), strict=True)), np.uint64, len(left))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    found[rows] = np.packbits(2 * ones > per_row[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return found


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long of the same bits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints(buf, at) for _, _, buf, at in slices(batch.column(2))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


# ---- ball hashing --------------------------------------------------------------------------------------------


_LOW = np.uint64((1 << 32) - 1)
_ONE = np.uint64(1) << np.arange(32, dtype=np.uint64)
_TWO = np.array([_ONE[i] | _ONE[j] for i in range(32) for j in range(i)], np.uint64)
#: What a variant flips: nothing, one left bit, two left bits, one right bit, two right bits; and whether it is close.
MASKS = np.concatenate(([np.uint64(0)], _ONE << np.uint64(32), _TWO << np.uint64(32), _ONE, _TWO))
CLOSE = np.bitwise_count(MASKS) < 2
_LEFT_TWO, _RIGHT, _RIGHT_TWO = 1 + 32, 1 + 32 + len(_TWO), 1 + 32 + len(_TWO) + 32
#: Records by kind: by the right half with left flips, by the right half with one right bit flipped, and so by the left half.
OWN_RIGHT, FLIP_RIGHT, OWN_LEFT, FLIP_LEFT = 0, 1, 33, 34
RECORDS = (34 + 66) // 2


def records(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, kind) of all records."""
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    every, even = np.arange(len(fps), dtype=np.uint32), np.flatnonzero(~odd).astype(np.uint32)
    flips = np.arange(32, dtype=np.uint8)
    owner = np.concatenate((every, np.repeat(every, 32), every, np.repeat(even, 32)))
    kind = np.concatenate((np.full(len(fps), OWN_RIGHT, np.uint8), np.tile(FLIP_RIGHT + flips, len(fps)), np.full(len(fps), OWN_LEFT, np.uint8), np.tile(FLIP_LEFT + flips, len(even))))
    return owner, kind


def keys_of(fps: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The half by which a record is shuffled, and its table as the bit above."""
    by_left = kind >= OWN_LEFT
    half = np.where(by_left, fps >> np.uint64(32), fps & _LOW)
    flip = kind.astype(np.int64) - np.where(by_left, FLIP_LEFT, FLIP_RIGHT)
    half = np.where(flip >= 0, half ^ _ONE[np.maximum(flip, 0)], half)
    return half | (by_left.astype(np.uint64) << np.uint64(32))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def spelled(fps: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First mask and number of masks of each record's variants."""
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    begin = np.where(kind == OWN_RIGHT, np.where(odd, 0, 1), np.where(kind == OWN_LEFT, np.where(odd, _RIGHT_TWO, _RIGHT), 0))
    size = np.where(kind == OWN_RIGHT, np.where(odd, _RIGHT, 32), np.where(kind == OWN_LEFT, np.where(odd, len(_TWO), 32), 1))
    flip = kind.astype(np.int64)
    begin = np.where((kind >= FLIP_RIGHT) & (kind < OWN_LEFT), _RIGHT + flip - FLIP_RIGHT, np.where(kind >= FLIP_LEFT, 1 + flip - FLIP_LEFT, begin))
    return begin, size


def packed(fps: np.ndarray, bucket_bits: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of the records of some fingerprints; a block has the fingerprint and the kind of each record."""
    owner, kind = records(fps)
    bucket = _mix(keys_of(fps[owner], kind)) >> np.uint64(64 - bucket_bits) if bucket_bits else np.zeros(len(owner), np.uint64)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    owner, kind = owner[order], kind[order]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=1 << bucket_bits))))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[k], cuts[k + 1]
        yield k, fps[owner[a:b]].astype("<u8").tobytes() + kind[a:b].tobytes()


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and kinds of a block's records."""
    n = len(block) // 9
    return np.frombuffer(block, "<u8", n), np.frombuffer(block, np.uint8, n, 8 * n)


def bucket_links(fps: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the verified links among the records of one bucket."""
    key = keys_of(fps, kind)
    order = np.argsort(key)
    key, fps, kind = key[order], fps[order], kind[order]
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    live = np.bincount(group)[group] > 1 if len(key) else np.zeros(0, bool)
    fps, kind, group = fps[live], kind[live], group[live]
    begin, size = spelled(fps, kind)
    ends = np.cumsum(size)
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    bounds = np.append(first, len(fps))
    at = 0
    while at < len(first):  # whole groups, as many as are spelled out at once
        a = bounds[at]
        done = ends[a] - size[a]
        at = max(at + 1, int(np.searchsorted(ends[bounds[1:] - 1], done + SPELLED, "right")))
        b = bounds[min(at, len(first))]
        turns = -(-int(ends[b - 1] - done) // SPELLED)
        for turn in range(turns):  # a group that is larger is spelled out in turns, by a hash of the variant
            found = []
            step = max(1, SPELLED // MASKS.size)
            for c in range(a, b, step) if turns > 1 else [a]:
                d = min(b, c + step) if turns > 1 else b
                which = np.repeat(np.arange(c, d), size[c:d])
                mask = spans(begin[c:d], size[c:d])
                z = fps[which] ^ MASKS[mask]
                mine = _mix(z) % np.uint64(turns) == turn if turns > 1 else slice(None)
                found.append((fps[which][mine], z[mine], CLOSE[mask][mine]))
            fp, z, close = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(z)
            for side, new in zip((left, right), forest(*star_links(fp[order], z[order], close[order])), strict=True):
                side.append(new)
    return forest(np.concatenate(left), np.concatenate(right))


def star_links(fp: np.ndarray, key: np.ndarray, close: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that keep the components of fingerprints which collide on sorted keys."""
    left, right = [], []
    while len(key):
        group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        size = np.bincount(group)
        live = size[group] > 1
        fp, key, close, group = fp[live], key[live], close[live], group[live]
        if not len(key):
            break
        centre = np.full(group[-1] + 1, -1, np.int64)
        near = np.flatnonzero(close)[::-1]
        centre[group[near]] = near  # the first close one of each group is written last
        mine = centre[group]
        keep = (mine >= 0) & (mine != np.arange(len(key)))
        fp_at, fp_centre = fp[keep], fp[mine[keep]]
        linked = np.bitwise_count(fp_at ^ fp_centre) <= radius
        left.append(fp_centre[linked])
        right.append(fp_at[linked])
        rest = np.flatnonzero(keep)[~linked]  # a truncated hash brought strangers together: without this centre again
        fp, key, close = fp[rest], key[rest], close[rest]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of a local spanning forest, without the roots."""
    nodes, index = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = index[: len(left)], index[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def links(fps: DataFrame, n: int) -> DataFrame:
    """(a, b): links that keep the components of ``n`` distinct fingerprints in column fp."""
    bucket_bits = max(0, math.ceil(math.log2(max(1, n * RECORDS / BUCKET))))
    partitions = min(1 << bucket_bits, MOST_PARTITIONS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def blocks(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(fps), TASK_FPS):
                found = list(packed(fps[i : i + TASK_FPS], bucket_bits))
                for j in range(0, len(found), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found[j : j + 64]], pa.int64()), pa.array([b for _, b in found[j : j + 64]], pa.binary())], ["bucket", "block"])

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, waiting)) >= TASK_FPS:
                yield from blocks(np.concatenate(waiting))
                waiting = []
        if waiting:
            yield from blocks(np.concatenate(waiting))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def found() -> pa.RecordBatch:
            both = [np.concatenate(x) for x in zip(*own, strict=True)]
            own.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in bucket_links(*both)], ["a", "b"])

        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and own:
                    yield found()
                now = bucket
                own.append(unpacked(block.as_py()))
        if own:
            yield found()

    blocks = fps.select("fp").repartition(max(1, math.ceil(n / TASK_FPS))).mapInArrow(pack, "bucket long, block binary")
    dealt = blocks.repartitionById(partitions, F.pmod(F.col("bucket"), F.lit(partitions)).cast("int"))
    if 1 << bucket_bits > partitions:
        dealt = dealt.sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (one for each component), component_id (its smallest doc_id)."""
    spark = docs.sparkSession
    folder = work_dir(spark, "simhash")
    marked = stored(with_fingerprints(docs), f"{folder}/fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/nodes")
    found = stored(components(links(nodes, nodes.count())), f"{folder}/components")
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id (null last), fingerprint and text hash."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_hash")
    first = grouped(docs).groupBy("root").agg(F.min(rank).alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    rows = whole_rows(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "text_hash": F.xxhash64("row.text")})
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")), "left_semi")
    return kept.dropDuplicates(["id", "text_hash"]).select("row.*")

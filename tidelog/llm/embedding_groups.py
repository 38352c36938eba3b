"""Operator 9: near-duplicates among embedding vectors: spherical k-means cells, blocked cosine products between them.

Equal vectors are one class that is compared once. Every class has the nearest centroid's cell as its home; cells are
cut into blocks, and every pair of blocks is compared unless a bound shows that no pair of theirs can link. So no link
is missed and none is counted twice, whatever the centroids: these are an index, fitted on a bounded sample
(``SAMPLE_ROWS`` classes, or four for each cell), and decide only how much the bounds leave out. The bounds are taken
from all vectors, by the triangle inequality of angles:

* two cells whose centroids are further apart than both radii (the widest angle of any of their vectors) and the angle
  of a link have no link, so their blocks are not read;
* inside a block, vectors near one another are a ball with a centre and a radius of its own, and only the balls of two
  blocks that are near enough for a link are compared. One product of the centres, lengthened by the radii's cosines and
  sines, tells which. Where a block has nearly as many balls as vectors, all its vectors are compared.

Products are in single precision with a bound of their rounding errors; what that leaves open is decided in double precision.

Scale: where vectors come in families the cost is that of the square of the families, and with centroids far apart only
near cells are compared. Vectors spread evenly in many dimensions leave the bounds nothing to leave out: then all pairs of
classes are compared, and the cost grows with the square of the classes. Vectors move once to become classes (known by a 128-bit hash) and
once into their blocks, which are files in the shared folder; a task reads a block and, one by one, up to ``SPAN`` others,
so memory is bounded, a cell of any size is many tasks, and no plan holds pairs. A task emits a link count for each class
and a spanning forest, never all pairs. Centroids number ``MOST_CELLS`` at most and go with the tasks.

Edge cases: a vector that is null, empty, zero or has null or non-finite components links with nothing and is its own
component; others are scaled by their largest component first, so neither tiny nor huge ones are lost; vectors of different
lengths do not link, the ``MOST_LENGTHS`` commonest lengths have cells of their own and any other is one cell, compared in blocks; equal rows are two vectors that link;
a null vec_id takes part and names no component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidelog.llm.components import components
from tidelog.llm.shared import arrow_fs, lowest, small_batches, stored, work_dir
from tidelog.llm.simhash import forest

COSINE = 0.9
SAMPLE_ROWS = 20_000
CELL_ROWS = 2_000
#: Lengths of vectors that have centroids of their own, the commonest.
MOST_LENGTHS = 8
MANY_CELLS = 4_096
MOST_CELLS = 32_768
#: Vectors of a block, and their components.
BLOCK_ROWS = 4_000
BLOCK_VALUES = 1 << 22
#: Blocks that a task compares with its own, and Spark's tasks at most.
SPAN = 16
MOST_TASKS = 20_000
ITERATIONS = 12
#: Added to angles against rounding.
SLACK = 1e-6
#: Pairs are taken one by one where they are less than one in so many of a product.
SPARSE = 50


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, given finite rows that are not zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares over- or underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def n_cells(n_classes: int) -> int:
    return min(math.ceil(n_classes / CELL_ROWS), max(MANY_CELLS, math.ceil(math.sqrt(n_classes))), MOST_CELLS)


def fit_cells(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of unit vectors; starts from rows spread over the sample, deterministic."""
    if not len(x) or k < 1:
        return np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ITERATIONS):
        nearest = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1)
        full = size > 1e-9
        centres[full] = sums[full] / size[full, None]
    return centres


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(-1, dim)


def balls(x: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """The ball of each unit vector: a vector that is in none yet leads one, of all others in none at ``cosine`` or more from it."""
    single = x.astype(np.float32)
    ball, n = np.full(len(x), -1, np.int32), 0
    for at in range(0, len(x), 256):
        near = single[at : at + 256] @ single.T >= cosine
        for k in range(len(near)):
            if ball[at + k] < 0:
                ball[near[k] & (ball < 0)] = n
                ball[at + k] = n
                n += 1
    return ball


class Block(NamedTuple):
    """Unit vectors in the order of their balls, with the first row, size, centre and radius of each ball."""

    ids: np.ndarray
    n: np.ndarray
    x: np.ndarray
    single: np.ndarray
    first: np.ndarray
    size: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def block_of(ids: np.ndarray, n: np.ndarray, x: np.ndarray, ball: np.ndarray) -> Block:
    order = np.argsort(ball, kind="stable")
    ids, n, x, ball = ids[order], n[order], x[order], ball[order]
    first = np.flatnonzero(np.diff(ball, prepend=-1))
    size = np.diff(first, append=len(x))
    centre = np.add.reduceat(x, first)
    centre /= np.maximum(np.linalg.norm(centre, axis=1), 1e-9)[:, None]
    least = np.minimum.reduceat(np.einsum("ij,ij->i", x, np.repeat(centre, size, axis=0)), first)
    return Block(ids, n, x, x.astype(np.float32), first, size, centre, np.arccos(np.clip(least, -1, 1)) + SLACK)


def read_block(folder: str, k: int, dim: int) -> Block | None:
    """A block from the shared folder; None if no vector fell into it."""
    fs, path = arrow_fs(f"{folder}/block={k}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    rows = pq.read_table(path, filesystem=fs, partitioning=None).combine_chunks()
    vectors = pa.concat_arrays(rows["v"].chunks)
    return block_of(rows["id"].to_numpy(), rows["n"].to_numpy(), unit(_matrix(vectors, dim)), rows["ball"].to_numpy())


def rounding(dim: int) -> float:
    """More than the error of a product of two unit vectors in single precision, in any order of its sums."""
    return (dim + 16) * 2.0**-22


def near_balls(one: Block, other: Block, cosine: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of balls that may hold a link; None if telling them is no gain."""
    angle = math.acos(cosine) + SLACK
    if 4 * len(one.first) * len(other.first) > len(one.ids) * len(other.ids) or one.radius.max() + other.radius.max() + angle >= math.pi:
        return None
    # cos(centres) >= cos(radius + angle + other radius), the right side as a sum of two products
    wide = one.radius + angle
    left = np.column_stack((one.centre, -np.cos(wide), np.sin(wide))).astype(np.float32)
    right = np.column_stack((other.centre, np.cos(other.radius), np.sin(other.radius))).astype(np.float32)
    return np.nonzero(left @ right.T >= -3 * rounding(left.shape[1]))


def linked(one: Block, other: Block, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two blocks (which may be the same one) that link, each pair once, a strip at a time."""
    same = one is other
    dim = one.x.shape[1]
    slack = rounding(dim)

    def checked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = max(1, BLOCK_VALUES // dim)
        return np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", one.x[a[k : k + step]], other.x[b[k : k + step]]) >= cosine for k in range(0, len(a), step))])

    rows, columns = np.arange(len(one.ids)), np.arange(len(other.ids))
    found = near_balls(one, other, cosine)
    if found is not None:
        g, h = found
        if same:
            g, h = g[g <= h], h[g <= h]
        pairs = one.size[g] * other.size[h]
        if int(pairs.sum()) * SPARSE <= len(rows) * len(columns):
            k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            width = np.repeat(other.size[h], pairs)
            a, b = np.repeat(one.first[g], pairs) + k // width, np.repeat(other.first[h], pairs) + k % width
            if same:
                a, b = a[a < b], b[a < b]
            close = checked(a, b)
            yield a[close], b[close]
            return
        rows = np.flatnonzero(np.repeat(np.isin(np.arange(len(one.first)), g), one.size))
        columns = np.flatnonzero(np.repeat(np.isin(np.arange(len(other.first)), h), other.size))
    right = other.single if len(columns) == len(other.ids) else other.single[columns]
    for at in range(0, len(rows), 256):
        strip = rows[at : at + 256]
        first = int(np.searchsorted(columns, strip[0], "right")) if same else 0
        if first == len(columns):
            continue
        product = (one.single[strip] @ right[first:].T).ravel()
        place = np.flatnonzero(product >= cosine - slack)
        a, b = np.divmod(place, len(columns) - first)
        a, b, open_ = strip[a], columns[first + b], product[place] < cosine + slack
        close = ~open_
        close[open_] = checked(a[open_], b[open_])
        if same:
            close &= a < b
        yield a[close], b[close]


_FOUND = "a long, b long, n long"


def _found(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    """Link counts of classes, or (without n) links of a forest."""
    counts = pa.nulls(len(a), pa.int64()) if n is None else pa.array(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), counts], ["a", "b", "n"])


def compare(one: Block, others: Iterator[Block], cosine: float = COSINE) -> Iterator[pa.RecordBatch]:
    """Links of a block with others (itself may be one): a count for each class of a block, then one forest."""
    own = np.zeros(len(one.ids), np.int64)
    roots, leaves = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for other in others:
        theirs = np.zeros(len(other.ids), np.int64)
        for a, b in linked(one, other, cosine):
            np.add.at(own, a, other.n[b])
            np.add.at(theirs, b, one.n[a])
            if len(a):
                leaf, root = forest(one.ids[a].astype(np.uint64), other.ids[b].astype(np.uint64))
                leaves.append(leaf)
                roots.append(root)
        some = theirs > 0
        if some.any():
            yield _found(other.ids[some], other.ids[some], theirs[some])
    some = own > 0
    if some.any():
        yield _found(one.ids[some], one.ids[some], own[some])
    leaf, root = forest(np.concatenate(leaves), np.concatenate(roots))
    if len(leaf):
        yield _found(leaf, root)


class Group(NamedTuple):
    """The blocks of one length: the first one's number, how many; by block the centroid and radius of its cell, if there are any."""

    dim: int
    first: int
    blocks: int
    centres: np.ndarray | None
    radius: np.ndarray | None

    @property
    def spans(self) -> int:
        """Tasks of a block: it is compared with itself and the next half of all blocks, in a circle."""
        return math.ceil((self.blocks // 2 + 1) / SPAN)

    def others(self, i: int, span: int, cosine: float) -> list[int]:
        """Blocks that the task compares with block i and that may have a link with it."""
        step = np.arange(span * SPAN, min((span + 1) * SPAN, self.blocks // 2 + 1))
        if 2 * i >= self.blocks:  # two opposite blocks meet once
            step = step[2 * step != self.blocks]
        j = (i + step) % self.blocks
        if self.centres is not None:
            apart = np.arccos(np.clip(self.centres[j] @ self.centres[i], -1, 1))
            j = j[(j == i) | (apart <= self.radius[i] + self.radius[j] + math.acos(cosine) + SLACK)]
        return j.tolist()


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, exact: bool = True) -> DataFrame:  # noqa: ARG001
    """vec_id, n_links, component_id, kept. No link is missed; ``exact`` is there for callers that ask for that."""
    spark = vectors.sparkSession
    small_batches(spark)
    folder = work_dir(spark, "embeddings")
    given = vectors.schema["embedding"].dataType
    element = "float" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "double"
    v = F.transform("embedding", lambda e: e.cast(element))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    sound = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(sound, F.col("v")).alias("v"))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    grouped = rows.where("v is not null").groupBy("h1", "h2", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = stored(grouped.withColumn("id", F.monotonically_increasing_id()), f"{folder}/classes")
    lengths = classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "dim").collect()
    cells: dict[int, tuple[int, np.ndarray]] = {}  # by length: number of the first cell, centres
    for r in lengths[:MOST_LENGTHS]:
        if r["n"] > CELL_ROWS:
            alike = classes.where(F.size("v") == r["dim"])
            sample = lowest(alike, "h1", max(SAMPLE_ROWS, 4 * n_cells(r["n"])), "h2").select("v").toArrow().combine_chunks()
            first = sum(len(c) for _, c in cells.values())
            cells[r["dim"]] = (first, fit_cells(unit(_matrix(sample["v"].combine_chunks(), r["dim"])), n_cells(r["n"])))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            length = np.diff(lists.offsets.to_numpy())
            home, near = -length.astype(np.int32), np.full(len(length), -1.0)
            for dim, (first, centres) in cells.items():
                usual = np.flatnonzero(length == dim)
                if len(usual):
                    to_all = unit(_matrix(lists.take(pa.array(usual)), dim)) @ centres.T
                    home[usual], near[usual] = first + np.argmax(to_all, axis=1), to_all.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2), pa.array(home), pa.array(near)], ["id", "v", "n", "home", "near"])

    placed = classes.select("id", "v", "n").mapInArrow(assign, f"id long, v array<{element}>, n long, home int, near double")
    placed = stored(placed, f"{folder}/cells")
    sizes = {r["home"]: r for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).where("n > 1 or home >= 0").collect()}
    groups, blocks = [], []  # of blocks: home, number of the first block of the home, how many
    for dim in (r["dim"] for r in lengths):
        first_cell, centres = cells.get(dim, (-dim, None))
        homes = [h for h in range(first_cell, first_cell + (1 if centres is None else len(centres))) if h in sizes]
        most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // dim))
        own = [math.ceil(sizes[h]["n"] / most) for h in homes]
        first = blocks[-1][1] + blocks[-1][2] if blocks else 0
        at = first + np.cumsum([0, *own])
        blocks += [(h, int(at[k]), own[k]) for k, h in enumerate(homes)]
        if centres is None:
            groups.append(Group(dim, first, sum(own), None, None))
        else:
            radius = np.arccos(np.clip([sizes[h]["near"] for h in homes], -1, 1)) + SLACK
            groups.append(Group(dim, first, sum(own), np.repeat(centres[[h - first_cell for h in homes]], own, axis=0), np.repeat(radius, own)))

    def with_balls(rows: pa.Table) -> pa.Table:
        vectors = pa.concat_arrays(rows["v"].chunks)
        return rows.append_column("ball", pa.array(balls(unit(_matrix(vectors, len(vectors[0]))), cosine)))

    of_home = spark.createDataFrame(blocks, "home_ int, first int, own int")
    in_blocks = placed.join(F.broadcast(of_home), F.col("home") == F.col("home_"))
    in_blocks = in_blocks.select("id", "v", "n", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("own"))).cast("int").alias("block"))
    in_blocks = in_blocks.groupBy("block").applyInArrow(with_balls, f"id long, v array<{element}>, n long, block int, ball int")
    in_blocks.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/blocks")
    first_task = np.cumsum([0, *(g.blocks * g.spans for g in groups)])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                k = int(np.searchsorted(first_task, task, "right")) - 1
                group, (i, span) = groups[k], divmod(task - int(first_task[k]), groups[k].spans)
                others = group.others(i, span, cosine)
                one = read_block(f"{folder}/blocks", group.first + i, group.dim) if others else None
                if one is not None:
                    read = (one if j == i else read_block(f"{folder}/blocks", group.first + j, group.dim) for j in others)
                    yield from compare(one, (b for b in read if b is not None), cosine)

    n_tasks = int(first_task[-1])
    found = spark.range(0, n_tasks, 1, max(1, min(n_tasks, MOST_TASKS))).mapInArrow(compared, _FOUND)
    found = stored(found, f"{folder}/links")
    counts = found.where("n is not null").groupBy(F.col("a").alias("id_")).agg(F.sum("n").alias("links"))
    roots = components(found.where("n is null").select("a", "b"))
    named = classes.select("id", "h1", "h2", "n", "least").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy(F.col("root").alias("root_")).agg(F.min("least").alias("component_id"))
    known = named.join(least, F.col("root") == F.col("root_")).join(counts, F.col("id") == F.col("id_"), "left")
    known = known.select(F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    marked = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), "h2")
    joined = marked.join(known, (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")), "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    result = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

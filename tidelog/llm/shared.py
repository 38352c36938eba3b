"""What several operators of this package use: shared folders, tables, Arrow batches and word kernels.

Only the folder named in ``spark.checkpoint.dir`` is visible to the driver and to every executor, so each
intermediate table and each operator file lives below it. Where the setting is absent on a local master (tests, a
laptop) a temporary folder of this process takes its place; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to a Python worker, so that a batch of long texts stays small.
BATCH_ROWS = 1000
#: Its bytes: a batch ends with the row that passes them.
BATCH_BYTES = 8 << 20
#: Bytes of text that a numpy kernel looks at in one go.
KERNEL_BYTES = 2 << 20
#: Upper bits of a hash by which rows are counted before the lowest are taken.
LOWEST_BITS = 13
#: A word, as every operator counts words; the same pattern in Java's and in Python's syntax.
WORD = "[^\\x20\\x09-\\x0D]+"

_own_dir: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the cluster's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tidelog-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        base = f"file://{_own_dir[0]}"
    elif "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrow_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder URI and the path in it; works for local, HDFS and object stores."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def replace(fs: pafs.FileSystem, own: str, final: str) -> None:
    """Give a file its final name, also where an earlier attempt has left one and the store's move does not replace."""
    try:
        fs.move(own, final)
    except OSError:
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(final)
        fs.move(own, final)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that this session sends to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates that no plan reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(docs: DataFrame) -> DataFrame:
    """Every row as one struct column ``row``, so that no name of a document's own can clash with a helper's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def lowest(rows: DataFrame, key: str, limit: int, *then: str) -> DataFrame:
    """The ``limit`` rows of the lowest ``key`` (a 64-bit hash), and of the lowest ``then`` among equals, in that order.

    Rows are first counted by the upper bits of the key, so that of all rows only about as many as are wanted are sorted
    and reach the driver, not so many for every partition.
    """
    part = F.shiftright(F.col(key), 64 - LOWEST_BITS)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    last, so_far = None, 0
    for last, n in counts:
        so_far += n
        if so_far >= limit:
            break
    some = rows if last is None else rows.where(part <= last)
    return some.orderBy(key, *then).limit(limit)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n: the held-out folds."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the n + 1 offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = KERNEL_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch of texts so that a kernel sees about ``most`` bytes (one text at least) at a time.

    Yields first row, end row, bytes and offsets.
    """
    buf, at = text_buffer(texts)
    row = 0
    n = len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, buf[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def give_back() -> None:
    """Return memory that is free to the system, as a worker does that waits for its next task beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of rows that are worked on together: about ``most`` bytes of text, or one text that has more."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for begin, end, buf, _ in slices(batch.column(1), most):
            waiting.append(batch.slice(begin, end - begin))
            size += len(buf)
            if size >= most:
                yield _joined(waiting)
                waiting, size = [], 0
    if waiting:
        yield _joined(waiting)


def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays([p.column(k) for p in parts]) for k in (0, 1))


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of spans, one span after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z folded to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of all rows, and for each row the index of its first word (n + 1 values)."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[at] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006  the cache lives as long as the worker
    have = cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        cache[base] = have
    return have[:n]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over random byte values, taken from prefix sums, then mixed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    if len(buf) > 2 * KERNEL_BYTES and len(starts) > 1 and int((ends - starts).max()) < KERNEL_BYTES:
        found, at = [], 0
        while at < len(starts):
            low = int(starts[at])
            end = max(at + 1, int(np.searchsorted(ends, low + KERNEL_BYTES, "right")))
            found.append(word_hashes(buf[low : int(ends[end - 1])], starts[at:end] - low, ends[at:end] - low))
            at = end
        return np.concatenate(found)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(buf))[starts]
    return _mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0x8BB84B93962EACC9))

"""Operator 3: token ids as length-delimited binary records with a separate offset index.

A shard file is a run of frames, one for each document in ascending doc_id order::

    u64 length | u32 masked CRC of the length's bytes | payload | u32 masked CRC of the payload

(little-endian; the mask rotates a CRC-32 right by 15 bits and adds 0xA282EAD8, so that a CRC stored inside
checksummed data does not cancel). A payload is a byte that says whether doc_id is present, a byte
for the width of an id (2 where the vocabulary has no more than 65,536 ids, else 4), the doc_id as i64 and the ids. The index file beside it (``.idx``) has the magic ``TRX1``, a u32 format number and the u64 offset of
every frame, so a shuffled reader seeks straight to any record.

Encoding is by the tokenizers library. A byte-level pre-tokenizer always cuts before a single space that stands
between two non-space characters, and around a line break that does, so a text is cut there and each distinct segment
is looked up once in a group of texts and encoded once per worker.

Scale: one range exchange of the texts on doc_id and a hash of the text, whose partitions Spark sizes (an id that
many rows share, or a row that is repeated, is split); each task streams its own shard
to the shared folder under an attempt's name and renames it, so a lost executor or a second attempt leaves whole
files only. The driver holds a row for each shard, of which there are no more than shuffle partitions.

Edge cases: a null text is the empty text (the end id alone); equal doc_ids are ordered by the hash of their text; a null
doc_id comes first; an empty table gives no shard and no row; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.shared import arrow_fs, give_back, replace, small_batches, spans, text_groups, work_dir

END_ID = 2
MAGIC = b"TRX1"
FORMAT = 1
#: Distinct segments that a worker remembers.
CACHE_SEGMENTS = 1_000_000
#: Bytes of texts that are encoded together.
GROUP_BYTES = 4 << 20
#: Segments that stay when the memory is full: short ones are the frequent ones.
SHORT = 7
#: Segments that are encoded as one text: each begins with a space of its own, so their ids can be told apart.
JOINED = 100
#: Texts that go to the library at once.
AT_ONCE = 64
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters and then signs: the pre-tokenizer cuts between the two (an apostrophe may go either way).
_SIGNED = re.compile(r"([^\W\d_]+)([!\"#$%&()*+,\-./:;<=>?@\[\]^_`{|}~]+)")
#: White space other than the space and the line break.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and payload of each frame; raises ValueError where a checksum or a length does not hold."""
    at = 0
    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError(f"a frame is cut off at byte {at}")
        length, crc = struct.unpack("<QI", head)
        if crc != masked_crc(head[:8]):
            raise ValueError(f"the length at byte {at} is damaged")
        payload, tail = stream.read(length), stream.read(4)
        if len(payload) < length or len(tail) < 4:
            raise ValueError(f"a frame is cut off at byte {at}")
        if struct.unpack("<I", tail)[0] != masked_crc(payload):
            raise ValueError(f"the record at byte {at} is damaged")
        yield at, payload
        at += 16 + length


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<BBq", doc_id is not None, width, doc_id or 0) + ids


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    there, width, doc_id = struct.unpack_from("<BBq", payload)
    return (doc_id if there else None), np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


class Encoder:
    """Ids of whole texts, with a bounded memory of segments.

    ``known`` numbers a segment, kept without its leading space; ``flat`` has from ``at[number]`` on the ids that it has
    with that space. A segment that follows a line break carries the break instead of a space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(words.values()) + 1, bool)  # ids that begin with a space
        self.leads[[i for w, i in words.items() if w.startswith("\u0120")]] = True
        self.known: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; the library's own results are large, so a few at a time."""
        ids, size = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), self.kind))
            size.append(np.fromiter(map(len, found), np.int64, len(found)))
        return np.concatenate(ids), np.concatenate(size)

    @staticmethod
    def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Segments, and where each text's begin and how many it has."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        parts, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        begin, size = at[:-1] - at[0], np.diff(at)
        # white space beside other, or at an end: such a text is cut between words only
        bare = pc.not_equal(pc.binary_length(parts), pc.binary_length(pc.utf8_trim(parts, _BLANKS)))
        odd_part = pc.or_(bare, pc.or_(pc.equal(parts, ""), pc.equal(parts, "\n"))).to_numpy(zero_copy_only=False)
        odd = np.unique(np.searchsorted(begin, np.flatnonzero(odd_part), "right") - 1)
        if len(odd):
            cut = [_CUT.split(x) if x else [] for x in texts.take(pa.array(odd)).to_pylist()]
            size[odd] = [len(x) for x in cut]
            begin[odd] = len(parts) + np.cumsum(size[odd]) - size[odd]
            parts = pa.concat_arrays([parts, pa.array(list(chain.from_iterable(cut)), parts.type)])
        return parts, begin, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each begins (n + 1 values)."""
        parts, begin, size = self.segments(texts.fill_null(""))
        some = np.flatnonzero(size)
        first, first_size = self.coded(parts.take(pa.array(begin[some])).to_pylist())
        more = size[some] - 1
        place = spans(begin[some] + 1, more)
        distinct = parts.take(pa.array(place)).dictionary_encode()
        numbers, more_ids, more_size = self.numbers(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        numbers = numbers[distinct.indices.to_numpy()]
        # this group's own: letters with signs, then the first segments
        flat = np.concatenate((self.flat, more_ids, first))
        at = np.concatenate((self.at, self.at[-1] + np.cumsum(np.concatenate((more_size, first_size)))))
        order = np.insert(numbers, np.cumsum(more) - more, len(at) - 1 - len(some) + np.arange(len(some)))
        n_ids = at[order + 1] - at[order]
        ends = np.concatenate(([0], np.cumsum(n_ids)))
        return flat[spans(at[order], n_ids)], ends[np.concatenate(([0], np.cumsum(size)))]

    def numbers(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of segments, each there once; new ones are learnt.

        Letters and then signs have the ids of the letters and of the signs, so such a segment is not kept: it has a
        number past those that are known, and its ids and their number are returned.
        """
        known = self.known
        found = list(map(known.get, segments))
        missing = [k for k, n in enumerate(found) if n is None]
        signed = {k: m.groups() for k in missing if (m := _SIGNED.fullmatch(segments[k]))}
        new = {segments[k] for k in missing if k not in signed} | {x for word, sign in signed.values() for x in (word, " " + sign) if x not in known}
        if len(known) + len(new) > CACHE_SEGMENTS:
            self.forget()
            known = self.known
            rest = [s for k, s in enumerate(segments) if k not in signed]
            new = {s for s in (*rest, *(x for word, sign in signed.values() for x in (word, " " + sign))) if s not in known}
            found = [None] * len(segments)
        self.learn(new)
        size = np.zeros(0, np.int64)
        both = np.array([known[x] for word, sign in signed.values() for x in (word, " " + sign)], np.int64)
        if len(both):
            size = self.at[both + 1] - self.at[both]
        place = {k: len(self.at) - 1 + j for j, k in enumerate(signed)}
        numbers = [place[k] if k in place else known[s] if n is None else n for k, (s, n) in enumerate(zip(segments, found, strict=True))]
        return np.array(numbers, np.int64), self.flat[spans(self.at[both], size)], size[::2] + size[1::2]

    def forget(self) -> None:
        """Keep the short segments, which are the frequent ones."""
        short = [s for s in self.known if len(s) <= SHORT]
        if len(short) > CACHE_SEGMENTS // 2:
            short = []
        kept = np.fromiter(map(self.known.__getitem__, short), np.int64, len(short))
        size = self.at[kept + 1] - self.at[kept]
        self.flat = self.flat[spans(self.at[kept], size)]
        self.at = np.concatenate(([0], np.cumsum(size)))
        self.known = dict(zip(short, range(len(short)), strict=True))

    def learn(self, new: set[str]) -> None:
        """Number segments and encode them; a space before one says that it goes without."""
        alone = [s for s in new if s[:1] == "\n" or " " in s]
        self._add(alone, *self.coded([s if s[:1] == "\n" else s[1:] if s[:1] == " " else " " + s for s in alone]))
        spaced = list(new.difference(alone))
        ids, _ = self.coded([" " + " ".join(spaced[i : i + JOINED]) for i in range(0, len(spaced), JOINED)])
        begin = np.flatnonzero(self.leads[ids])
        if len(begin) != len(spaced):
            raise ValueError("the tokenizer joins segments")
        self._add(spaced, ids, np.diff(np.append(begin, len(ids))))

    def _add(self, segments: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(segments, range(len(self.at) - 1, len(self.at) - 1 + len(segments)), strict=True))
        self.flat = np.concatenate((self.flat, ids))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _put(fs, final: str, attempt: str, write) -> None:
    """Write under the attempt's own name, then give the file its final name."""
    own = f"{final}.{attempt}"
    with fs.open_output_stream(own) as out:
        write(out)
    replace(fs, own, final)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the records of (doc_id, text) below ``folder`` and return the shards: shard, n_docs, n_tokens."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), str(context.taskAttemptId())
        fs, path = arrow_fs(folder)
        code, offsets, n_tokens, at = encoder(tokenizer), [], 0, 0
        end = end_id.to_bytes(code.width, "little")
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs.create_dir(path, recursive=True)
        final = f"{path}/shard-{shard:06d}.rec"

        def records(out):
            nonlocal n_tokens, at
            for rows, texts in text_groups(chain([first], batches), GROUP_BYTES):
                doc_ids = rows.to_pylist()
                ids, ends = code.encode(texts)
                n_tokens += len(ids) + len(doc_ids)
                for doc_id, begin, stop in zip(doc_ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    data = frame(payload_of(doc_id, ids[begin:stop].tobytes() + end, code.width))
                    offsets.append(at)
                    at += len(data)
                    out.write(data)

        _put(fs, final, attempt, records)
        _put(fs, final + ".idx", attempt, lambda out: out.write(MAGIC + struct.pack("<I", FORMAT) + np.asarray(offsets, "<u8").tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([len(offsets)], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})
        give_back()

    shards = dealt.mapInArrow(shard_of, "shard long, n_docs long, n_tokens long")
    at = f"{folder}/shards"
    shards.write.mode("overwrite").parquet(at)
    return docs.sparkSession.read.schema("shard long, n_docs long, n_tokens long").parquet(at)


def read_records(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Every record read back and checked: doc_id, start, n_tokens, ids_crc32, shard, offset (byte of the frame)."""
    base, rows = 0, []
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):  # a row for each shuffle partition at most
        rows.append((r["shard"], r["n_docs"], base))
        base += r["n_tokens"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = arrow_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name, start = f"{path}/shard-{row['shard']:06d}.rec", row["base"]
                with fs.open_input_stream(name + ".idx") as f:
                    index = f.read()
                offsets = np.frombuffer(index, "<u8", offset=8)
                if index[:4] != MAGIC or len(offsets) != row["n_docs"]:
                    raise ValueError(f"the index of shard {row['shard']} is damaged")
                out: list[tuple] = []
                with fs.open_input_stream(name, buffer_size=1 << 20) as f:
                    for k, (at, payload) in enumerate(frames(f)):
                        if k >= len(offsets) or at != offsets[k]:
                            raise ValueError(f"the index of shard {row['shard']} does not fit its records")
                        doc_id, ids = parsed(payload)
                        out.append((doc_id, start, len(ids), zlib.crc32(ids), row["shard"], at))
                        start += len(ids)
                        if len(out) == 20_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    listed = spark.createDataFrame(rows, "shard long, n_docs long, base long")
    return listed.mapInArrow(records, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], list(names))


def record_at(folder: str, shard: int, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a shard by its index: doc_id and ids, for readers that shuffle."""
    fs, path = arrow_fs(folder)
    name = f"{path}/shard-{shard:06d}.rec"
    with fs.open_input_file(name + ".idx") as f:
        f.seek(8 + 8 * k)
        at = struct.unpack("<Q", f.read(8))[0]
    with fs.open_input_file(name) as f:
        f.seek(at)
        _, payload = next(frames(f))
    return parsed(payload)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write the records of documents and return them as read back from the files."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "records")
    return read_records(spark, folder, write_records(docs, folder, tokenizer, end_id)).select(
        F.col("doc_id"), F.col("start"), F.col("n_tokens"), F.col("ids_crc32"), F.col("shard"), F.col("offset")
    )

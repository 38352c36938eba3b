import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import doc, odd_table
from tidelog.llm import token_records as r
from tidelog.llm.shared import work_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(docs):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).collect()
    for x in sorted(rows, key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.hash)):
        ids = np.asarray([*t.encode(x.text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((x.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    docs = odd_table(spark)
    folder = work_dir(spark, "t")
    shards = r.write_records(docs, folder, PATH)
    got = sorted(((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in r.read_records(spark, folder, shards).collect()), key=lambda x: x[1])
    assert got == expected(docs)
    one = shards.orderBy("shard").first()
    doc_id, ids = r.record_at(folder, one.shard, one.n_docs - 1)
    assert ids[-1] == 2 and len(ids) == {x[0]: x[2] for x in got}[doc_id]


def test_spaces(spark):
    texts = ["a b", " a", "a ", "a  b", "a \n b", "a\nb", "\n", "a\n\nb", "a\tb c", "I'm don't", "x y z", "12 3,4 !?"]
    docs = odd_table(spark, [doc(k, t) for k, t in enumerate(texts)])
    got = sorted((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in r.token_records(docs, PATH).collect())
    assert got == expected(docs)


def test_empty(spark):
    assert r.token_records(odd_table(spark, []), PATH).count() == 0


def test_damage():
    data = r.frame(b"abc") + r.frame(b"")
    assert [p for _, p in r.frames(io.BytesIO(data))] == [b"abc", b""]
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(r.frames(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(r.frames(io.BytesIO(data[:-1])))
    assert r.parsed(r.payload_of(None, b"\1\0", 2))[0] is None


def test_segments_like_whole_texts(monkeypatch):
    import random

    rng = random.Random(1)
    signs = [" "] * 6 + ["\n"] * 3 + ["\t", "\r", "\x0b", "\xa0", "\u3000", "\x1c", "\x85", "<|endoftext|>", "'s", "n't", "word", "tion", *"abcXYZ19.,!'é日<|>_$"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(6000)] + [None, "", " "]
    whole = r.Encoder(PATH).tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)
    for most in (1_200_000, 500):  # the second forgets again and again
        monkeypatch.setattr(r, "CACHE_SEGMENTS", most)
        encoder = r.Encoder(PATH)
        for at in range(0, len(texts), 300):
            ids, ends = encoder.encode(pa.array(texts[at : at + 300]))
            for k, want in enumerate(whole[at : at + 300]):
                assert ids[ends[k] : ends[k + 1]].tolist() == want.ids, texts[at + k]


def test_equal_ids_are_spread(spark):
    docs = odd_table(spark, [doc(7, f"text {k} of one id") for k in range(300)] + [doc(None, "same text")] * 300)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = r.write_records(docs, work_dir(spark, "t"), PATH).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(x.n_docs for x in shards) == 600 and max(x.n_docs for x in shards) < 300
    assert sorted((str(x.doc_id), x.start) for x in r.token_records(docs, PATH).collect()) == sorted((str(x[0]), x[1]) for x in expected(docs))


def test_a_second_attempt_replaces(spark):
    docs, folder = odd_table(spark), work_dir(spark, "t")
    r.write_records(docs, folder, PATH)
    shards = r.write_records(docs, folder, PATH)
    assert sorted((str(x.doc_id), x.start, x.ids_crc32) for x in r.read_records(spark, folder, shards).collect()) == sorted((str(x[0]), x[1], x[3]) for x in expected(docs))

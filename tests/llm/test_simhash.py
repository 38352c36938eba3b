import random

import numpy as np
import xxhash

from tests.llm.fixtures import doc, lower, odd_table, words
from tidelog.llm import simhash as s
from tidelog.llm.components import components


def fingerprint(text):
    w = words(lower(text))
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else []))]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_documents(spark):
    docs = odd_table(spark, [x for x in odd_table(spark).collect()] + [doc(100 + k, "lorem ipsum " * 5 + str(k // 5)) for k in range(20)])
    rows = docs.collect()
    fps = [fingerprint(r.text) for r in rows]
    root = roots(fps)
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", least.get(k)) for r, f, k in zip(rows, fps, root, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in s.near_duplicates(docs).collect()) == want
    assert s.near_duplicates(odd_table(spark, [])).count() == 0


def test_links_find_every_pair(spark, monkeypatch):
    rng = random.Random(5)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(60):  # pairs at each distance, chains and a dense ball
        x = rng.getrandbits(64)
        fps |= {x} | {x ^ sum(1 << b for b in rng.sample(range(64), d)) for d in (1, 2, 3, 3, 4)}
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)}
    fps = sorted(fps)
    root = roots(fps)
    want = {}
    for f, k in zip(fps, root, strict=True):
        want.setdefault(k, set()).add(f)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for bucket, partitions, once in ((3_000_000, 20_000, 3_000_000), (400, 5, 700)):  # the second: many buckets, groups in turns
        monkeypatch.setattr(s, "BUCKET", bucket)
        monkeypatch.setattr(s, "MOST_PARTITIONS", partitions)
        monkeypatch.setattr(s, "SPELLED", once)
        got = {}
        for r in components(s.links(df, len(fps))).collect():
            got.setdefault(r.root, set()).add(int(np.int64(r.node).view(np.uint64)))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def met(fps):
    owner, kind = s.records(fps)
    begin, size = s.spelled(fps[owner], kind)
    key = np.repeat(s.keys_of(fps[owner], kind), size)
    z = fps[np.repeat(owner, size)] ^ s.MASKS[s.spans(begin, size)]
    half = np.where(key >> np.uint64(32) == 1, z >> np.uint64(32), z & np.uint64(0xFFFFFFFF))
    assert (half == key & np.uint64(0xFFFFFFFF)).all()  # a record's variants share the half it is shuffled by
    return key, z, np.repeat(owner, size)


def test_variants_meet_at_every_distance():
    rng = random.Random(6)
    for d in range(5):
        for _ in range(150):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample(range(64), d))
            key, z, owner = met(np.array([x, y], np.uint64))
            of = lambda k: set(zip(key[owner == k].tolist(), z[owner == k].tolist(), strict=True))  # noqa: E731, B023
            assert bool(of(0) & of(1)) or d == 4 or d == 0
    odd = sum(1 << b for b in (3, 40, 50))  # all variants within half the radius: one bit, two bits of a half, none
    assert len({v for v in met(np.array([odd], np.uint64))[1].tolist()}) == 1 + 32 + 496 + 32 + 496
    assert len({v for v in met(np.array([0], np.uint64))[1].tolist()}) == 64


def test_bytes_of_a_fingerprint_do_not_grow_with_buckets():
    fps = np.random.default_rng(3).integers(0, 1 << 63, 5_000).astype(np.uint64)
    size = [sum(len(b) for _, b in s.packed(fps, bits)) / len(fps) for bits in (0, 6, 9, 12)]
    assert max(size) == min(size) < 9 * 67


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 100), (7, 3), (200, 201), (None, 1)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(51)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_keeps_a_row_of_each_component(spark):
    import corpus_pipeline

    text = lambda x: " ".join(f"{x}{k}" for k in range(60))
    rows = [doc(None, text("one")), doc(None, text("two")), doc(None, text("two")), doc(7, text("three")), doc(7, text("four")), doc(3, text("four")), doc(9, text("three"))]
    kept = corpus_pipeline.near_duplicates_stage(spark, odd_table(spark, rows), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", text("one")), ("None", text("two")), ("7", text("three")), ("3", text("four"))])

"""Each stage of the corpus pipeline, and all of them, on small tables with odd rows."""

import random
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline as p
from tests.llm.fixtures import doc, odd_table, words
from tests.llm.test_rules_and_mix import base
from tidelog.llm import pieces, quality_model, simhash


def prose(rng, n=40):
    return " ".join(rng.choice("river stone light window garden seven morning quiet letter bridge winter road field".split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder with documents (good prose, junk, copies, odd rows) and labels, and the documents."""
    rng, folder = random.Random(6), tmp_path_factory.mktemp("sf")
    rows = [doc(100 + k, prose(rng), "abc"[k % 3]) for k in range(120)]
    rows += [doc(300 + k, " ".join(rng.choice(["$$$", "BUY!!", "a|b", "#now", "CHEAP"]) + str(rng.randint(0, 999)) for _ in range(40)), "abc"[k % 3]) for k in range(40)]
    rows += [doc(400 + k, rows[k][1], "b") for k in range(5)] + [doc(100, rows[7][1], "a"), doc(None, prose(rng), None), doc(None, prose(rng), "c")]
    docs = odd_table(spark, [*rows, *odd_table(spark).collect()])
    docs.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(100 + k, 1, 0) for k in range(120)] + [(300 + k, 0, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", docs


def same_columns(got, docs):
    assert got.columns == docs.columns
    return got.collect()


def test_rules(spark, made):
    got = same_columns(p.quality_rules_stage(spark, made[1], made[0]), made[1])
    want = [r for r in made[1].collect() if not base(r.text)[-1]]  # no line is in over ten texts
    assert Counter((r.doc_id, r.text, r.source, r.key) for r in got) == Counter((r.doc_id, r.text, r.source, r.key) for r in want)


def test_model(spark, made):
    got = same_columns(p.quality_model_stage(spark, made[1], made[0]), made[1])
    scores = {(r.doc_id, r.text_hash): r.predicted for r in quality_model.quality_scores(made[1], spark.read.parquet(f"{made[0]}/labels.parquet")).collect()}
    hashed = made[1].selectExpr("*", "xxhash64(text) as h").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in hashed if scores[r.doc_id, r.h])
    ids = {r.doc_id for r in got}
    assert len(ids & set(range(100, 220))) >= 115 and len(ids & set(range(300, 340))) <= 2
    # a good and a bad text under one id: each goes by its own
    two = odd_table(spark, [doc(5, made[1].where("doc_id = 101").first().text), doc(5, made[1].where("doc_id = 301").first().text)])
    kept = p.quality_model_stage(spark, made[1].union(two), made[0]).where("doc_id = 5 and n_chars > 100").collect()
    assert [r.text for r in kept] == [two.collect()[0].text]


def test_near_duplicates(spark, made):
    got = same_columns(p.near_duplicates_stage(spark, made[1], made[0]), made[1])
    groups = {}
    for r in simhash.grouped(made[1]).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    assert len(got) == len(groups)
    assert Counter(str(r.doc_id) for r in got) == Counter(str(min((d for d in g if d is not None), default=None)) for g in groups.values())


def test_mixing(spark, made):
    got = same_columns(p.mixing_stage(spark, made[1], made[0]), made[1])
    texts = {}
    for r in made[1].collect():
        texts.setdefault((r.doc_id, r.source), []).append(" ".join(words(r.text)))
    assert all(r.n_chars == len(r.text) and words(r.text) for r in got)
    assert all(any(" ".join(words(r.text)) in t or len(words(r.text)) < len(words(t)) for t in texts[r.doc_id, r.source]) for r in got)
    size = sum(len(words(r.text)) for r in made[1].collect())
    assert abs(sum(len(words(r.text)) for r in got) - size) < 0.2 * size


def test_encoding(spark, made):
    known = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    got = p.encoding_stage(spark, made[1], made[0]).collect()
    texts = [r.text for r in made[1].collect()]
    want = [(tuple(w[0][1].tolist()), len(w)) for w in known.encode(texts)]
    assert Counter((tuple(r.ids), r.n_ways) for r in got) == Counter(want)
    assert all(r.same and r.n_pieces == len(r.ids) for r in got)


def test_run(spark, made):
    got = p.run(spark, made[0]).collect()
    docs = made[1]
    for _, stage in p.STAGES:
        docs = stage(spark, docs, made[0])
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r.doc_id, tuple(r.ids)) for r in docs.collect())
    ids = {r.doc_id for r in got}
    assert ids <= {r.doc_id for r in made[1].collect()} and not ids & set(range(400, 405)) and len(ids & set(range(300, 340))) <= 2


def test_stages_on_empty_tables(spark, made):
    none = odd_table(spark, [])
    for name, stage in p.STAGES:
        got = stage(spark, none, made[0])
        assert got.count() == 0 and (name == "encoding" or got.columns == none.columns)

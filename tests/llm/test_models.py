import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.llm.fixtures import doc, lower, odd_table, words
from tidelog.llm import embedding_groups, ngram_trie, pieces, quality_model, toxicity
from tidelog.llm.shared import text_buffer, word_bounds, word_hashes

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def labelled(spark, bad, good, n=160):
    rng = random.Random(4)
    text = lambda k: " ".join(rng.choice(bad if k % 4 == 0 and rng.random() < 0.3 else good) for _ in range(rng.randint(15, 90)))
    docs = [doc(1000 + k, text(k)) for k in range(n)]
    labels = spark.createDataFrame([(1000 + k, int(k % 4 != 0), int(k % 4 == 0), 5) for k in range(n)] + [(5, None, None, 1)], "doc_id long, quality int, toxic int, x int")
    return odd_table(spark, [*odd_table(spark).collect(), *docs]), labels


def test_quality(spark):
    docs, labels = labelled(spark, ["JUNK!!", "$$$", "a|b"], ["plain", "prose", "is", "good"])
    got = quality_model.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    fresh = [r for r in got if r.held_out and (r.doc_id or 0) >= 1000]
    assert fresh and np.mean([r.predicted == (r.doc_id % 4 != 0) for r in fresh]) >= 0.9
    none = quality_model.quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.quality_scores(odd_table(spark, []), labels).count() == 0


def plain_features(text):
    b, ws = (text or "").encode(), [w.encode() for w in words(text)]
    n, size = max(1, len(ws)), max(1, len(b))
    of = lambda members: sum(x in members for x in b) / size
    symbols = set(b"#*$%&<>|@^~_=+\\{}[]")
    letter = lambda x: x >= 128 or chr(x).isalpha()
    upper = set(range(65, 91))
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    repeated = sum(c for c in windows.values() if c > 1)
    lines = [x for x in b.split(b"\n") if words(x.decode())]
    n_lines, dup = max(1, len(lines)), sum(c for c in Counter(lines).values() if c > 1)
    return [
        math.log1p(len(b)), math.log1p(len(ws)), sum(map(len, ws)) / n, of(upper), of(set(range(48, 58))), of(symbols), of({33}), of({124}),
        of(set(b".,;:?'\"()-/")), sum(x >= 128 for x in b) / size, sum(x < 32 and x != 10 for x in b) / size, sum(len(w) <= 3 for w in ws) / n,
        sum(len(w) > 14 for w in ws) / n, sum(not any(map(letter, w)) for w in ws) / n, len(set(ws)) / n, max(Counter(ws).values(), default=0) / n,
        repeated / n, math.log1p(repeated), math.log1p(len(ws) / n_lines), dup / n_lines, sum(w[-1] in symbols or w[-1] == 33 for w in ws) / n,
        sum(sum(map(letter, w)) == sum(x in upper for x in w) > 1 for w in ws) / n,
    ]


def test_features_and_scores_by_hand(spark):
    import pyarrow as pa

    texts = [r.text for r in odd_table(spark).collect()] + ["SHOUT NOW!! at #tags #tags a|b", "a b c d e\n\na b c d e\n x", "é É ÉA AB 日本", "w " * 40]
    buf, at = text_buffer(pa.array(texts))
    got = quality_model.features(buf, at)
    want = np.array([plain_features(t) for t in texts])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-6)
    for k in range(7):  # alone in their batch, and between long texts
        few = " ".join(["now", "three", "words", "of", "seven", "or"][:k])
        buf, at = text_buffer(pa.array([few]))
        assert np.allclose(quality_model.features(buf, at), [plain_features(few)], rtol=1e-5, atol=1e-6)
        between = [doc(1, "long " * 250_000), doc(2, few), doc(3, "long " * 250_000)]
        rows = {r.doc_id: r.x for r in quality_model.with_features(odd_table(spark, between).coalesce(1)).collect()} if k in (0, 2, 3) else {2: plain_features(few)}
        assert np.allclose(rows[2], plain_features(few), rtol=1e-5, atol=1e-6)
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality_model.FEATURES))).astype(np.float32)
    model = quality_model.fit(x, (x[:, 0] + x[:, 3] > 1).astype(float))
    for row, score in zip(got, model.score(got), strict=True):
        raw = model.base + sum(t[sum(c <= v for c in cuts)] for v, cuts, t in zip(row, model.cuts, model.tables, strict=True))
        raw += sum(t[sum(c <= row[i] for c in ci)][sum(c <= row[j] for c in cj)] for i, j, ci, cj, t in model.pairs)
        assert abs(score - 1 / (1 + math.exp(-max(-30, min(30, raw))))) < 1e-9


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_toxicity(spark):
    docs, labels = labelled(spark, ["horrid", "vileness", "vilest"], ["plain", "prose", "is", "good", "here"])
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    fresh = [r for r in got if r.held_out and (r.doc_id or 0) >= 1000]
    assert fresh and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in fresh]) >= 0.9
    none = toxicity.toxicity_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity_scores(odd_table(spark, []), labels).count() == 0


def test_network_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    import pyarrow as pa

    buf, at = text_buffer(pa.array(["one two three one four five", "six seven"]))
    w = toxicity.Words(buf, at)
    start, end, _ = toxicity.windows_of(w.first)
    index, mask = toxicity.window_index(w.index, start, end)
    x = net.inputs(w)[0].astype(np.float64)
    keep = {}
    logit = net.forward(x, index, mask, keep)
    grad, d_x = net.backward(keep, np.ones(len(logit)))
    for name, at_ in (("Wf", (4, 2)), ("Ub", (1, 5)), ("att", (3, 1)), ("key", (2, 0)), ("out", (9, 0)), ("cb", (1,)), ("bias", (0,))):
        old = net.p[name][at_]
        net.p[name][at_] = old + 1e-4
        up = net.forward(x, index, mask).sum()
        net.p[name][at_] = old - 1e-4
        down = net.forward(x, index, mask).sum()
        net.p[name][at_] = old
        assert abs((up - down) / 2e-4 - grad[name][at_]) < 1e-5, name
    windows = toxicity.windows_of(np.array([0, 0, 5, 32 + 5, 32 + 5 + 49]))
    assert [(a, b, r) for a, b, r in zip(*map(list, windows), strict=True)] == [(0, 0, 0), (0, 5, 1), (5, 37, 2), (37, 69, 3), (53, 85, 3), (69, 86, 3)]


def probability_by_hand(train, text, least=1):
    token = lambda t: [*words(lower(t)), None]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        s = token(t)
        c1.update(s)
        s = [None, *s]
        c2.update(itertools.pairwise(s))
        c3.update(zip(s, s[1:], s[2:], strict=False))
    n, v, d = sum(c1.values()), len(c1), 0.75
    kept = lambda c, total: {k: (x - d) / total(k) for k, x in c.items() if x >= least}
    p2, p3 = kept(c2, lambda k: c1[k[0]]), kept(c3, lambda k: c2[k[:2]])
    m2, m3 = Counter(), Counter()
    for k, p in p2.items():
        m2[k[0]] += p
    for k, p in p3.items():
        m3[k[:2]] += p
    s, base, score = [None, *token(text)], 0.0, 0.0
    for i in range(1, len(s)):
        p = (c1[s[i]] + 1) / (n + v + 1)
        base += math.log10(p)
        p = (1 - m2[s[i - 1]]) * p + p2.get((s[i - 1], s[i]), 0)
        if i > 1:
            p = (1 - m3[s[i - 2], s[i - 1]]) * p + p3.get(tuple(s[i - 2 : i + 1]), 0)
        score += math.log10(p)
    return len(s) - 1, sum(w in c1 for w in s[1:]), n, base, score


def test_language_model(spark, monkeypatch):
    import zlib

    rng = random.Random(9)
    vocabulary = [f"W{k}" for k in range(60)]
    rows = [*odd_table(spark).collect(), *(doc(2000 + k, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 120)))) for k in range(120))]
    docs = odd_table(spark, rows)
    train = [r.text for r in docs.collect() if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    for segment, chunk, partitions in ((16 << 20, 3_000_000, 20_000), (6_000, 500, 20_000), (2_000, 500, 3)):
        monkeypatch.setattr(ngram_trie, "SEGMENT_BYTES", segment)
        monkeypatch.setattr(ngram_trie, "MOST_PARTITIONS", partitions)
        monkeypatch.setattr(ngram_trie, "CHUNK_KEYS", chunk)
        got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_trie.language_scores(docs).collect()), key=lambda x: (x[0], x[1]))
        want = sorted(((str(r.doc_id), *probability_by_hand(train, r.text)) for r in docs.collect()), key=lambda x: (x[0], x[1]))
        for g, w in zip(got, want, strict=True):
            assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 * abs(w[4]) and abs(g[5] - w[5]) < 2e-3 * abs(w[5]) + 1e-3
    held = docs.where("doc_id = 2000").withColumn("doc_id", docs.doc_id * 0 + next(k for k in range(1, 99) if zlib.crc32(str(k).encode()) % 7 == 2))
    alone = ngram_trie.language_scores(held).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.score == 0.0
    assert ngram_trie.language_scores(odd_table(spark, [])).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 9], rng.integers(0, 1 << 62, 3000), rng.integers(0, 5000, 3000), np.concatenate((np.arange(2000), [1 << 60]))):
        values = np.sort(np.asarray(values, np.uint64))
        e = ngram_trie.EliasFano(ngram_trie.EliasFano.parts(values))
        assert (e.get(np.arange(len(values))) == values).all()
        probe = np.unique(np.concatenate((values, values + np.uint64(1), rng.integers(0, 1 << 62, 50).astype(np.uint64))))
        at = e.find(probe)
        known = set(values.tolist())
        assert [a >= 0 for a in at] == [p in known for p in probe.tolist()]
        assert (values[at[at >= 0]] == probe[at >= 0]).all() if len(values) else True
        low = rng.integers(0, len(values) + 1, len(probe))
        high = rng.integers(0, len(values) + 1, len(probe))
        inside = e.find(probe, low, high)
        assert [i >= 0 for i in inside] == [v in set(values[a:b].tolist()) for v, a, b in zip(probe.tolist(), low, high, strict=True)]


def brute(lattice, text, n):
    s, out = pieces.SPACE + text.replace(" ", pieces.SPACE), []

    def go(i, score, path):
        if i == len(s):
            out.append((score, tuple(path)))
            return
        whole = False
        for k in range(1, min(lattice.longest, len(s) - i) + 1):
            p = lattice.id_of.get(s[i : i + k])
            if p is not None:
                whole |= k == 1
                go(i + k, score + lattice.score_of[p], [*path, p])
        if not whole:
            go(i + 1, score + lattice.unknown, [*path, *(lattice.byte_id[b] for b in s[i].encode())])

    go(0, 0.0, [])
    return sorted(out, reverse=True)[:n]


def test_pieces_against_brute_force():
    known, rng = pieces.Lattice(MODEL), random.Random(5)
    texts = ["the cat", "a  b", "x\ny z", "日本 ж", "hello ", " on", "ü😀 a"] + ["".join(rng.choice("theaonr in ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for n in (1, 4, 9):
        for t, ways in zip(texts, known.encode(texts, n), strict=True):
            want = brute(known, t, n)
            assert [w for w, _ in ways] == [w for w, _ in want]
            assert len({tuple(i) for _, i in ways}) == len(ways) and all(known.decode(i) == t for _, i in ways)
    whole = {p for _, p in brute(known, "the cat", 10**6)}
    assert all(tuple(i.tolist()) in whole for _, i in known.encode(["the cat"], 9)[0])


def test_pieces_documents(spark):
    docs = odd_table(spark)
    got = pieces.encoded(docs, MODEL).collect()
    assert len(got) == docs.count() and all(r.same for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].ids == [] == by[2].ids and by[1].n_ways == 1 and by[1].score == 0
    assert pieces.encoded(odd_table(spark, []), MODEL).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 16))
    rows = [(int(k), [float(x) for x in v], 0, "c") for k, v in enumerate(base)]
    rows += [(1000 + k, [float(x) for x in base[k % 40] + 0.12 * rng.standard_normal(16)], 0, "c") for k in range(200)]
    rows += [(2000 + k, [float(x) for x in base[0]], 0, "c") for k in range(30)] + [(2001, [float(x) for x in base[0]], 0, "c")]
    odd = [(3000, None, 0, "c"), (3001, [0.0] * 16, 0, "c"), (3002, [1.0] * 15 + [None], 0, "c"), (3003, [float("nan")] * 16, 0, "c"), (3004, [], 0, "c"), (3005, [float("inf")] * 16, 0, "c")]
    other = [(4000, [1.0, 0.0], 0, "c"), (4001, [2.0, 0.1], 0, "c"), (4002, [0.0, 1.0], 0, "c")]
    tiny = [(5000 + k, [c * 1e-200 for c in (1.0, 2.0, k / 9)] + [0.0] * 13, 0, "c") for k in range(3)]
    huge = [(5100, [1e200] * 16, 0, "c"), (5101, [2e200] * 16, 0, "c"), (5102, [-1e200] * 16, 0, "c")]
    rows += tiny + huge
    df = spark.createDataFrame(rows + odd + other, "vec_id long, embedding array<double>, label int, v string")
    want = groups_by_hand([(r[0], r[1]) for r in rows])
    by = {}
    for r in embedding_groups.embedding_groups(df).collect():
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert {k: v for k, v in by.items() if k in want} == want
    for r in odd:
        assert by[r[0]] == [(0, r[0], True)]
    assert (by[4000], by[4001], by[4002]) == ([(1, 4000, True)], [(1, 4000, False)], [(0, 4002, True)])
    assert embedding_groups.embedding_groups(df.where("false")).count() == 0


def groups_by_hand(rows):
    """Links, component and kept of each vector id by all pairs; an id that is there twice has two entries."""
    x = np.array([v for _, v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    ids = [k for k, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(close), strict=True):
        root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    found = {}
    for k, i in enumerate(ids):
        found.setdefault(i, []).append((int(close[k].sum()), least[find(k)], i == least[find(k)]))
    return found


def test_long_texts_train_by_excerpts(spark, monkeypatch):
    docs = odd_table(spark, [doc(k, " ".join(f"w{j}" for j in range(900 if k % 4 else 5))) for k in range(200)])
    labels = spark.createDataFrame([(k, k // 4 % 2) for k in range(200)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 10)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1500)
    got = toxicity.training_texts(docs, labels).to_pylist()
    assert Counter(r["y"] for r in got) == {0: 10, 1: 10} and all(len(r["text"]) <= 1500 for r in got)
    long = [r["text"].split() for r in got if len(r["text"]) > 100]
    assert long and all(w[0] == "w0" and int(w[-1][1:]) > 800 for w in long)
    assert toxicity.excerpt("x" * 5000, 700) == "x" * 700 and toxicity.excerpt("short é", 700) == "short é" and toxicity.excerpt(" " * 900, 700) == ""


def score_by_hand(net, text):
    """A plain loop over windows, words, states and their attention."""
    import pyarrow as pa

    marks = ".,:;!?\"'()[]{}*#$%&|<>-_"
    strip = lambda w: (w := w[1:] if len(w.encode()) > 1 and w[0] in marks else w)[:-1] if len(w.encode()) > 1 and w[-1] in marks else w
    found = [strip(strip(strip(w))) for w in words(lower(text))]
    vectors = {}
    for w in set(found):
        own = toxicity.Words(*text_buffer(pa.array([w])))
        grams, owner = own.grams()
        word, odds = toxicity.bucket(own.hashes, toxicity.ODDS_BITS)[0], [float(net.gram_odds[k]) for k in toxicity.bucket(grams, toxicity.ODDS_BITS)]
        assert set(owner.tolist()) == {0} and len(own.hashes) == 1
        mean = np.mean([net.p["gram"][k] for k in toxicity.bucket(grams, toxicity.EMBED_BITS)], axis=0)
        vectors[w] = np.concatenate(([net.word_odds[word], max(odds), np.mean(odds)], net.p["word"][toxicity.bucket(own.hashes, toxicity.EMBED_BITS)[0]], mean))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN
    best = -math.inf
    for at in range(0, max(1, len(found) - toxicity.STRIDE), toxicity.STRIDE):
        x = [vectors[w] for w in found[at : at + toxicity.WINDOW]]
        states = []
        for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            state, own = np.zeros(h), {}
            for t in order:
                a, u = x[t] @ net.p["W" + side] + net.p["c" + side], state @ net.p["U" + side]
                z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
                state = own[t] = (1 - z) * state + z * np.tanh(a[2 * h :] + r * u[2 * h :])
            states.append([own[t] for t in range(len(x))])
        both = [np.concatenate(s) for s in zip(*states, strict=True)]
        e = [math.exp(float((np.tanh(s @ net.p["att"]) @ net.p["key"])[0])) for s in both]
        pooled = sum((w / sum(e) * s for w, s in zip(e, both, strict=True)), np.zeros(2 * h))
        best = max(best, float((pooled @ net.p["out"])[0] + net.p["bias"][0]))
    return sigmoid(best)


def test_toxicity_scores_by_hand():
    import pyarrow as pa

    rng = random.Random(12)
    bad, good = ["vile", "horrid!", "(nasty)"], ["plain", "prose,", "is", "good", "Here", "ünder", "日本"]
    texts = [" ".join(rng.choice(bad if k % 3 == 0 and rng.random() < 0.2 else good) for _ in range(rng.randint(0, 120))) for k in range(60)]
    net = toxicity.train(*text_buffer(pa.array(texts)), np.array([float(k % 3 == 0) for k in range(60)]))
    some = [*texts[:12], "", "one", " ".join(good * 7)[:-1], "--- ...", "word " * 32, "word " * 33, "word " * 49]
    got = net.scores(*text_buffer(pa.array(some)))
    assert np.allclose(got, [score_by_hand(net, t) for t in some], atol=2e-5)


@pytest.mark.parametrize("kind", ["decaying", "low_rank", "rank_3", "unlinked"])
def test_embeddings_of_uneven_spectrum(spark, monkeypatch, kind):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(embedding_groups, "CELL_ROWS", 150)
    monkeypatch.setattr(embedding_groups, "PROBES", 400, raising=False)
    if kind in ("low_rank", "rank_3"):
        rank = 8 if kind == "low_rank" else 3
        base = rng.standard_normal((3000, rank)) @ rng.standard_normal((rank, 64))
        near = base[:1500] + 0.35 * rng.standard_normal((1500, rank)) @ rng.standard_normal((rank, 64))
    else:
        base = rng.standard_normal((3000, 64)) / np.arange(1, 65) ** (kind == "decaying")
        near = base[:1500] + 0.35 * rng.standard_normal((1500, 64)) / np.arange(1, 65) ** (kind == "decaying")
    x = np.concatenate([base, near if kind != "unlinked" else near[:40]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    close = embedding_groups.unit(x) @ embedding_groups.unit(x).T >= 0.9
    np.fill_diagonal(close, False)
    links = np.array([r.n_links for r in embedding_groups.embedding_groups(df).orderBy("vec_id").collect()])
    true = close.sum(axis=1)
    if kind == "low_rank":
        want = groups_by_hand(list(enumerate(x)))
        exact = {r.vec_id: [(r.n_links, r.component_id, r.kept)] for r in embedding_groups.embedding_groups(df, exact=True).collect()}
        assert exact == want
    assert true.sum() and (links <= true).all() and links.sum() >= (0.99 if kind != "unlinked" else 1) * true.sum()


def test_vectors_of_several_lengths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(embedding_groups, "CELL_ROWS", 40)
    base = {d: rng.standard_normal((150 if d < 9 else 20, d)) for d in (6, 8, 9)}
    rows = [v for d in base for v in [*base[d], *(base[d] + 0.08 * rng.standard_normal(base[d].shape))]]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: [(r.n_links, r.component_id, r.kept)] for r in embedding_groups.embedding_groups(df, exact=True).collect()}
    want = {}
    for d in base:
        want |= groups_by_hand([(k, v) for k, v in enumerate(rows) if len(v) == d])
    assert got == want


def test_blocks_of_a_cell_count_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.array([1.0] * 8) + 0.01 * rng.standard_normal((90, 8))
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_groups, "BLOCK_ROWS", 20)
    monkeypatch.setattr(embedding_groups, "CELL_ROWS", 30)
    got = embedding_groups.embedding_groups(df).collect()
    assert {r.n_links for r in got} == {89} and {r.component_id for r in got} == {0}


def all_groups(df):
    return {r.vec_id: [(r.n_links, r.component_id, r.kept)] for r in embedding_groups.embedding_groups(df).collect()}


def test_no_link_is_missed_whatever_the_sample(spark, monkeypatch):
    """Most links are tight, so a sample of them says little of the few that just link."""
    rng = np.random.default_rng(21)
    base = embedding_groups.unit(rng.standard_normal((3000, 10)))
    tight = base[:1500] + 0.002 * rng.standard_normal((1500, 10))
    aside = rng.standard_normal((200, 10))
    start = base[-200:]
    aside = embedding_groups.unit(aside - np.einsum("ij,ij->i", aside, start)[:, None] * start)
    wide = 0.901 * start + math.sqrt(1 - 0.901**2) * aside  # at cosine 0.901 from a vector that has no other link
    x = np.pad(np.concatenate([base, tight, wide]), ((0, 0), (0, 54))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = groups_by_hand([(k, v.astype(float)) for k, v in enumerate(x)])
    monkeypatch.setattr(embedding_groups, "CELL_ROWS", 150)
    monkeypatch.setattr(embedding_groups, "PROBES", 100, raising=False)
    monkeypatch.setattr(embedding_groups, "LINKED_PROBES", 10, raising=False)
    assert all_groups(df) == want
    monkeypatch.setattr(embedding_groups, "BLOCK_ROWS", 100)
    monkeypatch.setattr(embedding_groups, "fit_cells", lambda x, k: x[:k].copy())  # centroids that fit nothing
    assert all_groups(df) == want


@pytest.mark.parametrize("kind", ["families", "spread", "one_family", "both", "border"])
def test_linked_rows_of_two_blocks(kind):
    rng = np.random.default_rng(31)
    eg = embedding_groups
    spread, centres = rng.standard_normal((400, 12)), rng.standard_normal((12, 12))
    families = centres[rng.integers(0, 12, 400)] + 0.05 * rng.standard_normal((400, 12))
    if kind == "border":  # cosines within the error of single precision of 0.9
        first = np.eye(12)[0]
        angle = np.arccos(0.9) + np.concatenate([np.linspace(-1e-7, 1e-7, 399), [0.3]])
        x = np.concatenate([[first], np.column_stack((np.cos(angle), np.sin(angle), np.zeros((400, 10))))])
    else:
        x = {"families": families, "spread": np.concatenate([spread, spread[:50] + 0.3 * rng.standard_normal((50, 12))]), "one_family": 1 + 0.1 * rng.standard_normal((400, 12)), "both": np.concatenate([families, spread])}[kind]
    x = eg.unit(x)
    true = x @ x.T >= 0.9
    order = rng.permutation(len(x))
    left, right = order[: len(x) // 2], order[len(x) // 2 :]
    made = [eg.block_of(k, np.ones(len(k), int), x[k], eg.balls(x[k])) for k in (left, right)]
    if kind in ("families", "spread"):
        assert (eg.near_balls(*made, 0.9) is not None) == (kind == "families")
    for one, other, rows, columns in ((made[0], made[1], left, right), (made[0], made[0], left, left)):
        got = [(int(one.ids[i]), int(other.ids[j])) for a, b in eg.linked(one, other, 0.9) for i, j in zip(a, b, strict=True)]
        assert len(got) == len(set(got))
        if one is other:
            assert {frozenset(p) for p in got} == {frozenset((i, j)) for i in rows for j in rows if i < j and true[i, j]} and all(i != j for i, j in got) and len(got) == len({frozenset(p) for p in got})
        else:
            assert set(got) == {(i, j) for i in rows for j in columns if true[i, j]}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 64, 65])
def test_every_pair_of_blocks_meets_once(n):
    group = embedding_groups.Group(8, 0, n, None, None)
    met = Counter(frozenset((i, j)) for i in range(n) for span in range(group.spans) for j in group.others(i, span, 0.9))
    assert met == Counter(frozenset((i, j)) for i in range(n) for j in range(i + 1))


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["ab  cd", None, "", "\x0b\x1cé", "x" * 50, "ab"]
    buf, at = text_buffer(pa.array(texts))
    starts, ends, first = word_bounds(buf, at)
    got = [[buf[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in itertools.pairwise(first.tolist())]
    assert got == [words(t) for t in texts]
    h = word_hashes(buf, starts, ends)
    assert h[0] == h[-1] and len(set(h.tolist())) == len(h) - 1


def n_best_scores(lattice, text, n):
    """The n best scores over the whole lattice of a text, by dynamic programming."""
    s, best = pieces.SPACE + text.replace(" ", pieces.SPACE), [[0.0]]
    for e in range(1, len(s) + 1):
        found, whole = [], False
        for i in range(max(0, e - lattice.longest), e):
            p = lattice.id_of.get(s[i:e])
            if p is not None:
                whole |= i == e - 1
                found += [x + lattice.score_of[p] for x in best[i]]
        if not whole:
            found += [x + lattice.unknown for x in best[e - 1]]
        best.append(sorted(found, reverse=True)[:n])
    return best[-1]


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(6)
    signs = [" "] * 5 + ["\n", "\n", "\t", "  ", "\r\n", "don't", "...", "$$$", "ий", "日本語", "é", "ing", "the", "tion", *"abcdeinorst,.;!1920-_"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(20, 300))) for _ in range(120)] + ["\n", " \n ", "a\n", "x" * 100, "ab1" * 60]
    for units, parts in ((700_000, 700_000), (40, 60)):  # the second forgets again and again
        monkeypatch.setattr(pieces, "CACHE_UNITS", units)
        monkeypatch.setattr(pieces, "CACHE_PARTS", parts)
        known = pieces.Lattice(MODEL)
        for at in range(0, len(texts), 25):
            for t, ways in zip(texts[at : at + 25], known.encode(texts[at : at + 25]), strict=True):
                want = n_best_scores(known, t, 4)
                assert np.allclose([w for w, _ in ways], want, rtol=0, atol=1e-8), t
                assert len({tuple(i) for _, i in ways}) == len(ways) and all(known.decode(i) == t for _, i in ways)
    marked = ["a▁b", "▁", " ▁ ▁▁x", "", None]
    assert [known.decode(w[0][1]) for w in known.encode(marked)] == [x or "" for x in marked]


def test_pieces_of_a_very_long_unit():
    import resource
    import time

    known, rng = pieces.Lattice(MODEL), random.Random(8)
    known.encode(["warm up"])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(64_000))
    ways = known.encode([text])[0]
    assert len(ways) == 4 and all(known.decode(i) == text for _, i in ways)
    assert sorted((w for w, _ in ways), reverse=True) == [w for w, _ in ways]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000 and time.process_time() - began < 30


def test_lowest_rows(spark):
    from pyspark.sql import functions as F

    from tidelog.llm.shared import lowest

    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.xxhash64("id")).otherwise(-7).alias("h"), "id").repartition(4)
    every = sorted((r.h, r.id) for r in rows.collect())
    for limit in (1, 100, 1600, 5000):
        assert [(r.h, r.id) for r in lowest(rows, "h", limit, "id").collect()] == every[:limit]
    assert lowest(rows.where("false"), "h", 5).count() == 0

from collections import Counter

import numpy as np

from tests.llm.fixtures import doc, odd_table, words
from tidelog.llm import mixing, quality_rules


def base(text):
    t = text or ""
    w = words(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed


def test_base_counts(spark):
    docs = odd_table(spark)
    got = Counter((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs).collect())
    assert got == Counter((str(r.doc_id), *base(r.text)) for r in docs.collect())
    assert quality_rules.quality_rules(odd_table(spark, [])).count() == 0


def test_line_frequency(spark):
    notice = "All rights of this notice are reserved by the owner of this place 2024."
    body = lambda k: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x{chr(97 + j)}" for j in range(20))
    rows = [doc(k, f"{body(k)}\n{notice.replace('2024', str(2000 + k))}\n{body(k + 100)}", "host") for k in range(15)]
    rows += [doc(50, f"{notice}\n{notice}\n{notice.upper()}\nshort tail of words", "host")]
    rows += [doc(60 + k, f"{body(7)}\n{body(8)}\n{body(9)}", "other") for k in range(15)]  # copies are no boilerplate
    rows += [doc(90, f"{body(1)} {notice}", "other"), doc(91, f"{notice}\n{notice}\nend", "elsewhere")]
    docs = odd_table(spark, rows)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[k].kept and got[k].removed_words == 14 for k in range(15))
    assert got[50].removed_words == 42 and not got[50].kept
    assert all(got[60 + k].kept and got[60 + k].removed_words == 0 for k in range(15)) and got[90].removed_words == 0 and got[91].removed_words == 0
    clean = {r.doc_id: r for r in quality_rules.clean_documents(docs).collect()}
    assert clean[3].text == f"{body(3)}\n{body(103)}" and clean[3].n_chars == len(clean[3].text) and clean[3].key == "k"
    assert 50 not in clean and clean[60].text == f"{body(7)}\n{body(8)}\n{body(9)}"


def test_boilerplate_of_several_lines(spark):
    banner = [" ".join(f"{x}{y}" for y in "abcdefghijkl") for x in ("one", "two", "three")]
    body = lambda k: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x{chr(97 + j)}" for j in range(30))
    rows = [doc(k, "\n".join([*banner, body(k)]), "host") for k in range(15)]
    rows += [doc(100 + k, "\n".join([*banner, body(99)]), "host") for k in range(40)]  # copies do not hide the others' lines
    rows += [doc(200, "\n".join(banner), "host")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(odd_table(spark, rows)).collect()}
    assert {r.removed_words for r in got.values()} == {36} and not got[200].kept and got[0].kept and got[100].kept


def test_line_limit_has_a_ceiling(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LINE_SHARE", 0.1)
    monkeypatch.setattr(quality_rules, "MOST_LINE_DOCS", 20, raising=False)
    body = lambda k: " ".join(f"w{k}x{j}" for j in "abcdefghijklmnopqrst")
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    rows = [doc(k, body(letters(k)) + "\na notice" * (k < 30) + "\nanother notice" * (k < 18), "host") for k in range(600)]
    got = {r.doc_id: r.removed_words for r in quality_rules.quality_rules(odd_table(spark, rows)).collect()}
    assert all(got[k] == 2 * (k < 30) for k in range(600))


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    rest, out = sum(sizes.values()), {}
    while left:
        over = [s for s, w in left.items() if rest * w / sum(left.values()) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= 3 * sizes[s]
            del left[s]
    return out | {s: rest * w / sum(left.values()) for s, w in left.items()}


def test_mix(spark):
    rows = [x for x in odd_table(spark).collect()] + [doc(1000 + k, " ".join(f"t{j}" for j in range(k % 50 * 8)), "abcdé"[k % 5]) for k in range(200)]
    docs = odd_table(spark, rows)
    got = mixing.Mix(docs).shares().collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = targets(dict(sizes))
    assert len(got) == len(rows)
    by_target = Counter()
    for r in got:
        assert r.taken <= 3 * r.size
        by_target[r.target] += r.taken
    for source, target in want.items():
        found = next(t for t in by_target if abs(t - target) < 1e-6)
        assert abs(by_target[found] - sum(t for t in want.values() if abs(t - target) < 1e-6)) <= 2 * mixing.BLOCK_WORDS
    again = mixing.Mix(docs).shares().collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(len(words(r.text)) for r in mixed) == sum(r.taken for r in got)
    assert mixed[0].key == "k" and mixed[0].n_chars == len(mixed[0].text)
    assert mixing.Mix(odd_table(spark, [])).shares().count() == 0 and mixing.mixed_documents(odd_table(spark, [])).count() == 0


def test_counts_of_shards(spark):
    rows = [doc(k if k % 3 else None, " ".join(f"t{j}" for j in range(40 + k % 50)), ["a", "b", "c", None][min(3, k % 7)]) for k in range(900)]
    mix = mixing.Mix(odd_table(spark, rows), block_words=8, shard_slots=100)
    sources = {r["rank"]: r for r in mix.sources.collect()}
    counts = mix.counts.collect()
    shards = {r.shard for r in counts}
    assert len(shards) == -(-sum(s.n_slots for s in sources.values()) // 100) and len(counts) == len({(r["rank"], r.shard) for r in counts})
    taken = mix.spans.groupBy("rank", "shard").agg({"slot": "count"}).collect()
    blocks = Counter((r["rank"], r.shard) for r in mix.spans.select("rank", "shard", "slot").distinct().collect())
    assert blocks == {(r["rank"], r.shard): r.n for r in counts} and len(taken) == len(counts)
    for rank, s in sources.items():
        own = [r.n for r in counts if r["rank"] == rank]
        assert sum(own) == s.n_slots  # as many as the target says
        mean = s.n_slots / len(shards)  # a multinomial draw: sums of squares as chi-square has them
        spread = sum((n - mean) ** 2 / mean for n in own) + (len(shards) - len(own)) * mean
        assert 0.5 * len(shards) < spread < 1.6 * len(shards), (rank, spread, len(shards))
    every = mix.spans.select("rank", "slot", "turn", "block").distinct().collect()
    assert len({(r["rank"], r.slot) for r in every}) == len(every) == len({(r["rank"], r.turn, r.block) for r in every}) == sum(s.n_slots for s in sources.values())


def test_many_sources(spark):
    rows = [doc(k, "w " * (1 + k * k % 97), f"host{k * 7919 % 300:03d}.example") for k in range(900)]
    got = {r.target: r for r in mixing.Mix(odd_table(spark, rows)).shares().collect()}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = sorted(targets(dict(sizes)).values())
    assert all(min(abs(t - w) for w in want) < 1e-6 for t in got) and len(got) == len(set(np.round(want, 6)))


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"), F.lit(1).cast("long")).alias("p"))
        got = [r.p for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))

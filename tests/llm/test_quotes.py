"""Quotation linking against hand-made conversations."""

from tidelog.llm.quotes import linked_conversations


def rows(spark, data):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, conv_ string")
    return {(r.conv_id, r.turn): r for r in linked_conversations(df).collect()}


def test_nested_quotes_and_threads(spark):
    got = rows(spark, [
        (1, 0, "a", "Where is the station?\nI am lost.", None),
        (1, 1, "b", "Nice weather.", None),
        (1, 2, "c", "> where  is the STATION?\nLeft of the park.", "x"),
        (1, 3, "a", "> > Where is the station?\n> Left of the park.\n\nThanks", None),
        (1, 4, "d", "> never said this\nok", None),
        (2, 0, "a", "> Where is the station?", None),
        (2, 2, "a", None, None),
        (2, 3, None, "", None),
        (3, None, "a", "no turn", None),
    ])
    assert got[1, 2].reply_to == 0 and got[1, 2].thread == 0 and got[1, 2].text == "Left of the park."
    assert [got[1, t].position for t in range(5)] == [1, 2, 3, 4, 5] and [got[1, t].branch for t in range(5)] == [0, 0, 2, 2, 2]
    assert got[1, 3].reply_to == 2 and got[1, 3].thread == 0 and got[1, 3].quote_levels == 2 and got[1, 3].text == "Thanks"
    assert got[1, 4].reply_to == 3 and got[1, 4].thread == 0 and got[1, 4].text == "ok" and got[1, 4].quoted_lines == 1
    assert got[1, 0].reply_to is None and got[1, 1].reply_to == 0 and got[1, 1].formatted == "<|b|>\nNice weather.\n"
    assert got[2, 0].text == "" and got[2, 0].reply_to is None  # quoted only in another conversation
    assert got[2, 2].reply_to == 0 and got[2, 3].formatted == "<|unknown|>\n\n"
    assert got[3, None].reply_to is None and got[3, None].text == "no turn" and got[3, None].position == 0 and got[3, None].thread is None


def test_repeats_and_empty(spark):
    got = rows(spark, [(1, t, "a", "yes", None) for t in range(5)] + [(1, 7, "b", ">yes", None)] * 2)
    assert got[1, 7].reply_to == 4
    assert rows(spark, []) == {}
    far = rows(spark, [(1, 0, "a", "x", None), (1, 5000, "a", "y", None)])
    assert far[1, 5000].reply_to == 0


def test_reply_order(spark, monkeypatch):
    """Random trees of quotations against a walk over them, with chunks so small that runs and branches span them."""
    import random

    from tidelog.llm import quotes

    monkeypatch.setattr(quotes, "CHUNK_TURNS", 4)
    rng = random.Random(3)
    data, parent = [], {}
    for conv in range(6):
        for t in range(0, 120, 2):
            earlier = list(range(0, t, 2))
            origin = rng.choice(earlier if conv % 2 else earlier[-6:]) if earlier and rng.random() < 0.15 * conv else None
            data.append((conv, t, "a", (f"> line {origin} here\n" if origin is not None else "") + f"line {t} here", None))
            parent[conv, t] = origin if origin is not None else t - 2 if t else None
    got = rows(spark, data)
    for conv in range(6):
        kids = {}
        for t in range(0, 120, 2):
            kids.setdefault(parent[conv, t], []).append(t)
        walk, open_ = [], [0]
        while open_:
            walk.append(open_.pop())
            open_ += sorted(kids.get(walk[-1], []), reverse=True)
        assert [got[conv, t].position for t in walk] == list(range(1, 61))
        assert all(got[conv, t].reply_to == parent[conv, t] and got[conv, t].thread == 0 for t in walk)
        assert all(got[conv, t].branch == (t if parent[conv, t] != t - 2 or not t else got[conv, t - 2].branch) for t in walk)
    df = quotes.in_reply_order(linked_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, x string")))
    assert [(r.conv_id, r.position) for r in df.collect()] == [(c, k) for c in range(6) for k in range(1, 61)]

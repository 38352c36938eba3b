"""Rules: parsing, and the Spark column against the Python evaluator."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.errors import FilterConflict, RuleInvalid
from tidelog.plans import cel, publication, rules, subscription
from tidelog.schema import CHANGE_SCHEMA, ROW_TYPE, qualified, text

NAMES = ("eq", "neq", "gt", "lt", "gte", "lte", "contains", "starts_with", "is_null", "is_not_null")


def event(lsn, op, after, table=("public", "t")):
    row = None if after is None else [(n, 0, v) for n, v in after]
    return (lsn, 1, op, table, "0" * 16, row, None, 0)


def test_parse():
    r = rules.parse("op:insert,U,bogus,Delete ; a == 1;junk; b >= x y ;; c=5; = 3; d != 'q'")
    assert r.ops == {"insert", "update"}
    assert r.predicates == (rules.Predicate("a", "eq", "1"), rules.Predicate("b", "gte", "x y"), rules.Predicate("d", "neq", "'q'"))
    assert rules.parse("op:nope") == rules.Rule() and rules.parse("") == rules.Rule()
    # the first symbol in order of priority, wherever it stands
    assert rules.parse("a > b != c").predicates == (rules.Predicate("a > b", "neq", "c"),)


@given(st.text(max_size=60))
def test_parse_never_fails(expression):
    rules.parse(expression)


def test_column_equals_evaluator(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([None, "", "1", "10", "9", "é", "z", "abc", "ab"])
    rows = [event(i, rng.choice(["insert", "update", "delete", "truncate"]), rng.choice([None, [("a", value()), ("b", value())], [("b", value())], []])) for i in range(200)]
    log = spark.createDataFrame(rows, CHANGE_SCHEMA).cache()
    for name in NAMES:
        for wanted in ("9", "a", ""):
            rule = rules.Rule(frozenset(["insert", "delete"]) if wanted == "9" else frozenset(), (rules.Predicate("a", name, wanted),))
            got = {r.lsn for r in log.where(rules.column(rule)).select("lsn").collect()}
            want = {r[0] for r in rows if rules.accepts(rule, r[2], None if r[5] is None else {n: v for n, _, v in r[5]})}
            assert got == want, (name, wanted)


def test_rule_set_and_read_filter(spark):
    log = spark.createDataFrame([event(1, "insert", [("a", "1")]), event(2, "insert", [("a", "2")]), event(3, "insert", [("a", "2")], ("public", "u"))], CHANGE_SCHEMA)
    own = rules.RuleSet.from_config({"public.t": "a == 1"})
    assert [r.lsn for r in own.apply(log).orderBy("lsn").collect()] == [1, 3]
    own.add("public.t", "a == 2")
    assert [r.lsn for r in own.apply(log).orderBy("lsn").collect()] == [2, 3]
    assert rules.RuleSet().apply(log).count() == 3
    assert rules.ReadFilter(tables=()).apply(log).count() == 0 and rules.ReadFilter().apply(log).count() == 3
    assert [r.lsn for r in rules.ReadFilter(("public.t",), 2, 2).apply(log).collect()] == [2]


def test_cel_errors(spark):
    translate = cel.Translator(cel.struct_fields("data", ["a"]), cel.struct_fields("old", ["a"]))
    for bad in ("row.b == 1", "row.a ==", "nothing > 1", "row.a.shout()", "row.a == 1 row", "null", "row.a < null", "a # b"):
        with pytest.raises(RuleInvalid):
            translate(bad)


def test_cel_values(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "x"), (3, 'a"b', "x")], "a long, s string, o string").select(F.struct("a", "s").alias("data"), F.struct(F.col("o").alias("s")).alias("old"))
    translate = cel.Translator(cel.struct_fields("data", ["a", "s"]), cel.struct_fields("old", ["s"]))
    ids = lambda e: [r.a for r in df.where(translate(e)).select("data.a").orderBy("a").collect()]
    assert ids("row.s == null") == [2] and ids("null != row.s") == [1, 3] and ids("row.s != 'abc'") == [3]
    assert ids("row.s == \"a\\\"b\"") == [3] and ids("row.a in [1, 3] && !(row.a == 1)") == [3]
    assert ids("row.a > -1 && row.s.size() == 3") == [1, 3] and ids("old.s == row.s || true") == [1, 2, 3] and ids("row.s.matches('^a.c$')") == [1]


def test_projection_and_subscription(spark):
    log = spark.createDataFrame([event(1, "insert", [("a", "1"), ("b", "2")]), event(2, "delete", None), event(3, "insert", [("b", "5")], ("public", "u"))], CHANGE_SCHEMA)
    got = {r.lsn: r for r in subscription.projected(log, {"public.t": ["b", "zz"]}).collect()}
    assert [c.name for c in got[1].after] == ["b"] and got[2].after is None and [c.name for c in got[3].after] == ["b"]
    assert [tuple(r) for r in subscription.missing_columns(log, {"public.t": ["b", "zz"]}).collect()] == [("public.t", "zz", 1)]
    with pytest.raises(FilterConflict):
        subscription.check(subscription.Subscription("c", columns={"public.t": ["a"]}), {"public.t": ["b"]})
    own = subscription.Subscription("c", ("public.t",), ("insert", "delete"), resume=2)
    assert [r.lsn for r in subscription.subscribe(log, own).collect()] == [2]
    assert subscription.inspect_report(0, "p")["warnings"] == ["nothing passes"]


def test_publication(spark):
    assert publication.reconcile({"a": "add", "b": "keep"}, True, True) == ["add a"]
    assert publication.reconcile({}, False, True) == ["create publication"] and publication.reconcile({}, True, False) == ["skip external publication"]


def test_empty_row_is_not_absent(spark):
    log = spark.createDataFrame([event(1, "insert", []), event(2, "truncate", None)], CHANGE_SCHEMA)
    rule = rules.column(rules.parse("a == 1"))
    assert [r.lsn for r in log.where(rule).collect()] == [2]
    assert log.select(text(F.col("after"), "a").alias("v"), qualified().alias("q")).collect()[0].v is None
    assert log.schema["after"].dataType == ROW_TYPE

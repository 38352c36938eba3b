"""The SQL of native operators against their queries on tables with odd cases and quotations."""

import duckdb

from tests.llm.fixtures import SCHEMA, doc, odd_documents
from tidelog.llm import queries


def compare(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    key = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    want = sorted(key(r) for r in found.fetchall())
    got = sorted(key(r) for r in queries.queries()[name](spark, f"file://{tmp_path}").select(*columns).collect())
    assert got == want


def test_quotes(spark, tmp_path):
    text = lambda k: [f"say {k % 7}", f"> say {k % 5}\nanswer {k}", f"> > say {k % 3}\n>  answer {k - 3}\n\nno {k}", f"> lost\n>say {k % 4}\n> Say  {k % 2}\nyes", None, "say 1\nsay 2"][k % 6]
    rows = [(k % 6, k // 6 if k % 50 else None, ["user", None][k % 9 == 0], text(k * 7 + k // 5)) for k in range(240)]
    compare(spark, tmp_path, "op5_quotes", "conversations", [*rows, rows[7]], "conv_id long, turn long, role string, text string")


def test_rules(spark, tmp_path):
    rows = odd_documents() + [doc(100 + k, f"{'abcdefghijklmnopqrst'[k]} unlike any other line {'z' * k}\nThis line is on every page\nand {'y' * k} more words to fill", "h") for k in range(20)]
    compare(spark, tmp_path, "op6_quality_rules", "documents", rows, SCHEMA)


def test_mix(spark, tmp_path):
    seen = set()
    rows = [r for r in odd_documents() if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]
    rows += [doc(100 + k, " ".join(["w"] * (k * 13 % 400)), "pqrstuv"[k % 7]) for k in range(150)]
    compare(spark, tmp_path, "op4_mixing", "documents", rows, SCHEMA)

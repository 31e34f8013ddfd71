import re
from collections import Counter

import duckdb

from roadglass.llm import quality, queries


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = t.split("\n")
    real = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(lines[k] in lines[:k] for k in real), len(hit), len(real), sum(bool(re.search("[A-Za-z\x80-\U0010ffff]", x)) for x in w))


def test_measures(odd, odd_texts, sf_documents):
    got = sorted((r["doc_id"] or -1, *[r[n] for n in quality.MEASURES]) for r in quality.ledger(odd, "text", "doc_id").collect())
    assert got == sorted((i or -1, *brute(t)) for i, t in odd_texts)
    for r in sf_documents.collect():
        assert quality.measure(r["text"]) == brute(r["text"])


def test_policies_and_ablation(spark):
    led = spark.createDataFrame([(0,), (0,), (1,), (1,), (3,), (4,), (5,), (32,)], "failed_bits long")
    assert quality.apply_policy(led, "base").where("kept").count() == 4
    assert quality.apply_policy(led, "v1").where("kept").count() == 2
    got = {r["rule"]: (r["failed"], r["failed_only_here"], r["kept_without"]) for r in quality.ablation(led, "v1").collect()}
    assert got["few_words"] == (4, 2, 4) and got["repeated_windows"] == (1, 0, 2) and got["symbols"] == (2, 1, 3) and got["no_letters"] == (1, 1, 3)


def test_empty(empty):
    assert quality.ledger(empty, "text", "doc_id").count() == 0
    assert quality.ablation(quality.ledger(empty, "text", "doc_id")).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    q = queries.QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.001")
    cols = ", ".join(q.columns)
    assert sorted(map(tuple, q.collect())) == sorted(con.sql(f"select {cols} from ({queries.ORACLE_SQL['op8_quality_rules']})").fetchall())


def test_ablation_query(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["quality_ablation"](spark, sf).collect())
    assert got == sorted(con.sql(queries.ORACLE_SQL["quality_ablation"]).fetchall())

import math
import random

from pyspark.sql import functions as F

from roadglass.llm import topk


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % every == 0:
            best = {(-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q)}
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(sorted(best)[:k], 1)}
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("n", F.lit(1))
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0, k).collect()}


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "CHUNK", 8)
    rng = random.Random(2)
    f = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f(rng.gauss(0, 0.2)) for _ in range(8)]) for i in range(400)]
    rows += [(i + 1000, list(rows[7][1])) for i in range(150)]  # a vector that repeats, with ties
    rows += [(50, None), (100, [1.0, None]), (2000, [float("nan")] * 8), (2050, [float("inf")] + [0.0] * 7), (None, [0.5] * 8), (2100, [0.5, 0.25]), (2101, [0.5, -0.25]), (2150, [])]
    rows += [(150, list(rows[150][1])), (3, list(rows[3][1]))]  # repeated rows
    assert run(spark, rows) == brute(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == set()
    assert run(spark, []) == set()
    large = [(0, [1e5, -3.0]), (1, [2e6, 5.0]), (2, [2e6, 4.0]), (3, [-2e6, 4.0])]
    assert run(spark, large) == brute(large)
    huge = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 1.0]), (3, [0.0, 1.0])]
    assert [s for *_, s in sorted(run(spark, huge))] == [2**63 - 1, 65536, -(2**63)]

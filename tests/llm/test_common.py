import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import functions as F

from roadglass.llm import _common, queries

SF = "/root/testdata/sf0.001"


def tables(spark):
    return {p.name for p in Path(_common.folder(spark).removeprefix("file:")).glob("*")}


def test_settled_leaves_its_result_only(spark):
    before, rows = tables(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    setting = spark.conf.get(rows)

    def double(spark, n):
        _common.tune(spark)
        kept, _ = _common.written(spark.range(n), "on-the-way")
        return _common.bucketed(kept, "also", 2, "id").select((F.col("id") * 2).alias("id"))

    out = _common.settled(double)(spark, 5)
    assert sorted(r["id"] for r in out.collect()) == [0, 2, 4, 6, 8]
    (left,) = tables(spark) - before
    assert left.startswith("double-") and spark.conf.get(rows) == setting
    _common.sweep(spark, [p for p in _common._WRITTEN if not p.endswith(left)])
    assert tables(spark) == before


def test_queries_leave_their_result_only(spark):
    before = tables(spark)
    for name in ("op4_byte_shards", "op7_url_filter"):
        queries.QUERIES[name](spark, SF).collect()
    assert {x.split("-")[0] for x in tables(spark) - before} == {"op4_byte_shards", "op7_url_filter"}


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 7), (8, None)]
    found = _common.components(spark.createDataFrame(edges, "u long, v long")).collect()
    by = {r["node"]: r["root"] for r in found}
    assert len(found) == 300 + 101 and len({by[i] for i in range(300)}) == 1 and len({by[i] for i in range(1000, 1101)}) == 1
    assert by[0] != by[1000]


def test_settled_calls_in_threads_leave_each_other_alone(spark):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    setting, gate = spark.conf.get(rows), threading.Barrier(3, timeout=120)

    def slow(spark, n):
        kept, _ = _common.written(spark.range(n), "slow")
        gate.wait()  # all have written before any ends
        inner = _common.settled(lambda spark: kept.selectExpr("id + 1 as id"))
        inner.__wrapped__.__name__ = "inner"
        out = inner(spark)
        gate.wait()
        return out

    with ThreadPoolExecutor(3) as pool:
        outs = list(pool.map(lambda n: _common.settled(slow)(spark, n), (10, 20, 30)))
    assert [df.count() for df in outs] == [10, 20, 30] and spark.conf.get(rows) == setting


def test_queries_in_threads(spark):
    names = ("op4_byte_shards", "op7_url_filter", "op8_quality_rules", "op13_kd_clusters")
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda n: queries.QUERIES[n](spark, SF).count(), names))
    assert counts == [200, 50, 200, 500]

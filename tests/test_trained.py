import numpy as np
from pyspark.sql import functions as F

from roadglass.operators import risk
from roadglass.operators.trained import TrainedProvider
from roadglass.streaming import scores


def fitted(spark, rows, version="v1"):
    df = spark.createDataFrame(rows, "u string, p string, y double")
    return TrainedProvider.fit(df, F.col("u"), F.col("p"), F.col("y"), version, "d1")


def test_as_least_squares(spark, tmp_path):
    """The scores are those of numpy's least squares over the same means, before and after saving."""
    rng = np.random.default_rng(3)
    rows = [(f"u{rng.integers(9)}", f"p{rng.integers(4)}", float(rng.random())) for _ in range(300)] + [(None, "p1", 0.5), ("u1", None, 0.5), ("u1", "p1", None)]
    good = [r for r in rows if None not in r]
    mean = lambda k, v: float(np.mean([r[2] for r in good if r[k] == v] or [r[2] for r in good]))
    x = np.array([(1.0, mean(0, u), mean(1, p)) for u, p, _ in good])
    w = np.linalg.lstsq(x, np.array([r[2] for r in good]), rcond=None)[0]
    asked = [("u1", "p1"), ("u2", "gone"), ("gone", "p3"), ("gone", "gone"), (None, "p1"), ("u1", "p1")]
    want = [None if None in a else round(float(np.clip(w @ [1.0, mean(0, a[0]), mean(1, a[1])], 0, 1)), 4) for a in asked]
    provider = fitted(spark, rows)
    provider.save(str(tmp_path))
    fitted(spark, rows[:50], "v2").save(str(tmp_path))
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, spatial_unit_id string, period_id string")
    for p in (provider, TrainedProvider.load(spark, str(tmp_path), "v1")):
        got = risk.scored(df, p).orderBy("i").collect()
        assert [r["value"] for r in got] == want and got[0]["label"] in ("low", "mid", "high") and got[4]["label"] is None
        assert {(r["provider"], r["model_version"], r["dataset_version"]) for r in got} == {("trained", "v1", "d1")}
    assert TrainedProvider.load(spark, str(tmp_path), "v2").model_version == "v2"


def test_in_place_of_the_default(spark):
    s = risk.Service(spark, provider=fitted(spark, [("miraflores", "period-a", 1.0), ("b", "period-b", 0.0), ("c", "period-a", 0.5), ("b", "period-c", 0.25)]))
    rows = s.risk_map("period-a").collect()
    assert len(rows) == 8 and all(0 <= r["value"] <= 1 and r["label"] for r in rows) and s.model_metadata()["provider"] == "trained"
    assert s.risk("x", "y")["provider"] == "trained"


def test_no_events(spark):
    df = spark.createDataFrame([("a", "b")], "spatial_unit_id string, period_id string")
    assert risk.scored(df, fitted(spark, [])).first()["value"] is None


def test_scores_a_stream(spark, tmp_path):
    provider = fitted(spark, [("a", "p", 0.2), ("b", "q", 0.8), ("a", "q", 0.5)])
    spark.createDataFrame([("a", "p"), ("z", "q")], "spatial_unit_id string, period_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("spatial_unit_id string, period_id string").parquet(str(tmp_path / "in"))
    q = scores.scored_stream(stream, provider).writeStream.format("memory").queryName("trained").start()
    q.processAllAvailable()
    q.stop()
    want = risk.scored(spark.read.parquet(str(tmp_path / "in")), provider).collect()
    assert sorted(spark.table("trained").collect()) == sorted(want)

import json

import pytest
from pyspark.sql import functions as F

from roadglass.operators import risk
from roadglass.streaming import scores

#: By hashlib from the rule of the score, per unit in catalog order for the three periods.
VECTORS = {
    "cercado-de-lima": (0.5913, 0.2279, 0.5552),
    "la-victoria": (0.9256, 0.6725, 0.1179),
    "san-isidro": (0.8795, 0.7961, 0.8008),
    "miraflores": (0.7872, 0.2068, 0.3653),
    "santiago-de-surco": (0.9704, 0.9524, 0.1965),
    "san-miguel": (0.9506, 0.3027, 0.4608),
    "los-olivos": (0.2874, 0.9852, 0.3137),
    "san-juan-de-lurigancho": (0.7476, 0.3508, 0.4695),
}


def test_service(spark):
    s = risk.Service(spark, "test")
    assert s.health() == {"status": "ok", "environment": "test"}
    assert s.model_metadata()["dataset_version"] == "unconfigured"
    assert [r["spatial_unit_id"] for r in s.spatial_units().collect()] == list(VECTORS)
    assert [tuple(r) for r in s.periods().collect()] == [("period-a", "Period A"), ("period-b", "Period B"), ("period-c", "Period C")]
    for k, period in enumerate(("period-a", "period-b", "period-c")):
        rows = s.risk_map(period).collect()
        assert [(r["spatial_unit_id"], r["value"]) for r in rows] == [(u, v[k]) for u, v in VECTORS.items()]
        assert rows[0]["label"] is None and rows[0]["name"] == "Cercado de Lima" and rows[0]["latitude"] == -12.0464
    with pytest.raises(LookupError, match="Unknown period"):
        s.risk_map("period-z")


def test_points_and_comparisons(spark):
    s = risk.Service(spark)
    one = s.risk("area-a", "period-a")
    assert one == s.risk("area-a", "period-a") and 0 <= one["value"] <= 1 and one["label"] is None and one["provider"] == "default"
    got = s.compare([("b", "p"), ("a", "p"), ("b", "p")]).collect()
    assert [r["spatial_unit_id"] for r in got] == ["b", "a", "b"] and got[0] == got[2]
    assert s.compare([]).count() == 0
    for bad in (("", "p"), ("a", "")):
        with pytest.raises(ValueError):
            s.risk(*bad)


def test_provider_seam(spark):
    class Model:
        provider, model_version, dataset_version, description = "model", "1", "d", "a model"

        def score(self, unit, period):
            return F.length(unit) / 100

    s = risk.Service(spark, provider=Model())
    assert s.risk("abcd", "p")["value"] == 0.04 and s.risk_map("period-a").first()["provider"] == "model"


def test_client_side_operators(spark):
    items = spark.createDataFrame([(0, "a", 0.5), (1, "b", None), (2, "c", 1.0)], "ordinal int, spatial_unit_id string, value double")
    assert tuple(risk.average(items).first()) == (3, 0.75)
    assert tuple(risk.average(items.where("value is null")).first()) == (1, None)
    assert [risk.keep_selection(items, x).first()["spatial_unit_id"] for x in ("c", "gone", None)] == ["c", "a", "a"]
    assert risk.keep_selection(items.limit(0), "a").count() == 0
    names = spark.createDataFrame([(0, "a", "Alpha"), (1, "a", "Again")], "ordinal int, spatial_unit_id string, name string")
    assert [r["name"] for r in risk.with_names(items, names, "spatial_unit_id").orderBy("ordinal").collect()] == ["Alpha", "b", "c"]


def test_streams(spark, tmp_path):
    rows = [("2025-01-01 00:10:00", "u", "p", 1), ("2025-01-01 00:50:00", "u", "p", 2), ("2025-01-01 05:00:00", "v", "p", 3)]
    spark.createDataFrame(rows, "ts string, spatial_unit_id string, period_id string, n int").selectExpr("cast(ts as timestamp) ts", "spatial_unit_id", "period_id", "n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, spatial_unit_id string, period_id string, n int").parquet(str(tmp_path / "in"))
    q = scores.scored_stream(stream).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    want = risk.scored(spark.read.parquet(str(tmp_path / "in"))).select("n", "value").collect()
    assert sorted(spark.table("scored").select("n", "value").collect()) == sorted(want)
    counts = scores.windowed_counts(stream, "ts", "spatial_unit_id", {"all": None, "odd": F.col("n") % 2 == 1})
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["spatial_unit_id"], r["all"], r["odd"]) for r in spark.table("counted").collect()) == [("u", 2, 1), ("v", 1, 1)]


def test_bodies_and_defaults(spark):
    s = risk.Service(spark)
    assert json.loads(s.body(s.health()))["status"] == "ok"
    assert json.loads(s.body(s.risk_map("period-a")))[0]["label"] is None
    assert risk.comparison_defaults(risk.units(spark)) == ("cercado-de-lima", "la-victoria")
    assert risk.comparison_defaults(risk.units(spark).limit(1)) == ("cercado-de-lima", "cercado-de-lima")
    assert risk.comparison_defaults(risk.units(spark).limit(0)) == ("", "")

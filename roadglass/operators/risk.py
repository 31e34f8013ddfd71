"""Scores of spatial units and periods: points, maps, comparisons and what is shown of them."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.score import HashProvider, ScoreProvider

#: The catalog, in order.
UNITS = (
    ("cercado-de-lima", "Cercado de Lima", "area", -12.0464, -77.0428),
    ("la-victoria", "La Victoria", "area", -12.0678, -77.0150),
    ("san-isidro", "San Isidro", "area", -12.0977, -77.0365),
    ("miraflores", "Miraflores", "area", -12.1219, -77.0299),
    ("santiago-de-surco", "Santiago de Surco", "area", -12.1456, -76.9919),
    ("san-miguel", "San Miguel", "area", -12.0776, -77.0884),
    ("los-olivos", "Los Olivos", "area", -11.9912, -77.0708),
    ("san-juan-de-lurigancho", "San Juan de Lurigancho", "area", -11.9828, -77.0030),
)
PERIODS = (("period-a", "Period A"), ("period-b", "Period B"), ("period-c", "Period C"))


def units(spark: SparkSession) -> DataFrame:
    """The catalog's spatial units with their ordinal."""
    rows = [(i, *u) for i, u in enumerate(UNITS)]
    return spark.createDataFrame(rows, "ordinal int, spatial_unit_id string, name string, unit_type string, latitude double, longitude double")


def periods(spark: SparkSession) -> DataFrame:
    """The catalog's periods with their ordinal."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PERIODS)], "ordinal int, period_id string, name string")


def scored(df: DataFrame, provider: ScoreProvider | None = None, unit: str = "spatial_unit_id", period: str = "period_id") -> DataFrame:
    """df with value, label, provider, model_version, dataset_version.

    A provider that needs tables of its own to score has `score_rows`, which adds value and label to rows.
    """
    p = provider or HashProvider()
    if hasattr(p, "score_rows"):
        df = p.score_rows(df, unit, period)
    else:
        df = df.withColumns({"value": p.score(F.col(unit), F.col(period)), "label": F.lit(None).cast("string")})
    return df.withColumns({"provider": F.lit(p.provider), "model_version": F.lit(p.model_version), "dataset_version": F.lit(p.dataset_version)})


#: Periods of a block; a map whose periods fit one block sends them to every task.
BLOCK_PERIODS = 10_000


def risk_map(all_units: DataFrame, some_periods: DataFrame, provider: ScoreProvider | None = None) -> DataFrame:
    """Every unit in every given period with its score, repeats of either included.

    The periods are arrays of about BLOCK_PERIODS, and each unit meets every array once. Up to that many periods are one
    array, which is counted before it is broadcast, so the units are not shuffled; beyond, the units are dealt by block.
    """
    blocks = max(1, -(-some_periods.count() // BLOCK_PERIODS))
    block = F.pmod(F.xxhash64("period_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("__block")
    # Null ids are periods too, which a list would leave out.
    packed = some_periods.select(block, F.struct("period_id").alias("p")).groupBy("__block").agg(F.collect_list("p").alias("__periods"))
    each = all_units.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = each.join(F.broadcast(packed) if blocks == 1 else packed, "__block")
    rows = met.select(*[F.col(f"`{c}`") for c in all_units.columns], F.explode("__periods").alias("__p"))
    return scored(rows.withColumn("period_id", F.col("__p.period_id")).drop("__p"), provider)


def average(df: DataFrame, column: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (of each group `by`): rows, and the mean of the values that are there (null if none)."""
    return df.groupBy(*by).agg(F.count("*").alias("areas"), F.avg(column).alias("average_value"))


def with_names(df: DataFrame, names: DataFrame, on: str, name: str = "name") -> DataFrame:
    """df with the name of an id, or the id itself where there is none."""
    one = names.groupBy(F.col(on).alias("__id")).agg(F.min_by(name, "ordinal").alias("__name"))
    return df.join(one, F.col(on) == F.col("__id"), "left").withColumn(name, F.coalesce("__name", F.col(on).cast("string"))).drop("__id", "__name")


def keep_selection(items: DataFrame, selected: Column | str | None, by: tuple[str, ...] = ()) -> DataFrame:
    """The item that was selected if it is still there, else the first (of each group `by`); no row of no items."""
    first = F.struct(F.coalesce(F.col("spatial_unit_id") == selected, F.lit(False)).alias("chosen"), (-F.col("ordinal")).alias("early"))
    best = items.groupBy(*by).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in items.columns]), first).alias("item"))
    return best.where("item is not null").select("item.*")


def first_units(all_units: DataFrame, n: int = 2) -> DataFrame:
    """The first n units of the catalog, in order."""
    return all_units.orderBy("ordinal").limit(n)


def comparison_defaults(all_units: DataFrame) -> tuple[str, str]:
    """The two units a comparison starts from: the first and the second, or the first twice; empty without units."""
    ids = [r["spatial_unit_id"] for r in first_units(all_units).collect()]
    return (ids[0], ids[-1]) if ids else ("", "")


def known(asked: DataFrame, catalog: DataFrame, on: str) -> DataFrame:
    """Every row asked, with whether the catalog has its key."""
    have = catalog.select(on).distinct().withColumn("known", F.lit(True))
    return asked.join(have, on, "left").withColumn("known", F.coalesce("known", F.lit(False)))


class Service:
    """The operations of the risk interface, as DataFrames or rows, without a web server.

    The catalog is the built-in one, or any tables with its columns.
    """

    def __init__(self, spark: SparkSession, environment: str = "development", provider: ScoreProvider | None = None, catalog: DataFrame | None = None, dates: DataFrame | None = None):
        self.spark, self.environment, self.provider = spark, environment, provider or HashProvider()
        self.catalog, self.dates = catalog if catalog is not None else units(spark), dates if dates is not None else periods(spark)

    def health(self) -> dict[str, str]:
        return {"status": "ok", "environment": self.environment}

    def model_metadata(self) -> dict[str, str]:
        p = self.provider
        return {k: getattr(p, k) for k in ("provider", "model_version", "dataset_version", "description")}

    def spatial_units(self) -> DataFrame:
        return self.catalog.orderBy("ordinal").drop("ordinal")

    def periods(self) -> DataFrame:
        return self.dates.orderBy("ordinal").drop("ordinal")

    def risk(self, spatial_unit: str, period: str) -> dict[str, Any]:
        return self.compare([(spatial_unit, period)]).first().asDict()

    def risk_map(self, period: str) -> DataFrame:
        asked = known(self.spark.createDataFrame([(period,)], "period_id string"), self.dates, "period_id")
        if asked.where("known").isEmpty():
            raise LookupError("Unknown period")
        out = risk_map(self.catalog, asked.select("period_id"), self.provider).orderBy("ordinal")
        return out.select("spatial_unit_id", "period_id", "value", "label", "provider", "model_version", "dataset_version", "name", "latitude", "longitude")

    def compare(self, queries: list[tuple[str, str]]) -> DataFrame:
        """Scores in the order asked, repeats included; ids must not be empty."""
        if not all(u and p for u, p in queries):
            raise ValueError("ids must have at least one character")
        rows = self.spark.createDataFrame([(i, *q) for i, q in enumerate(queries)], "ordinal int, spatial_unit_id string, period_id string")
        return scored(rows, self.provider).orderBy("ordinal").drop("ordinal")

    def answers(self, requests: DataFrame, ordinal: str = "ordinal") -> DataFrame:
        """ordinal, status and body (JSON) of every row of requests, which hold spatial_unit_id and period_id.

        An id that is null or empty is answered with 422 and no body; the other rows go on. Any number of requests.
        """
        good = (F.coalesce(F.length("spatial_unit_id"), F.lit(0)) > 0) & (F.coalesce(F.length("period_id"), F.lit(0)) > 0)
        fields = ["spatial_unit_id", "period_id", "value", "label", "provider", "model_version", "dataset_version"]
        body = F.when(good, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
        rows = scored(requests.select(ordinal, "spatial_unit_id", "period_id"), self.provider)
        return rows.select(ordinal, F.when(good, 200).otherwise(422).alias("status"), body.alias("body"))

    @staticmethod
    def body(rows: DataFrame | dict[str, Any]) -> str:
        """What an interface would answer, as JSON; for results of catalog size."""
        return json.dumps(rows if isinstance(rows, dict) else [r.asDict(recursive=True) for r in rows.collect()], ensure_ascii=False)

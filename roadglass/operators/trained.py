"""A trained provider of scores: a regression on what a unit and a period have shown before.

`fit` keeps the mean target of every unit and of every period of an event table (two tables, however large) and fits a
linear model of the two means by `pyspark.ml`, whose sums run on the executors. A score is the model's value between 0
and 1, to four places; a unit or period that was not there has the mean of all. Its label is the bucket of the score.
Events with a null unit, period or target are left out; equal events count each; without any event every score is null.
`save` and `load` keep a provider under its version at any path that Spark writes to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.score import bucket

_UNIT, _PERIOD = "__unit_mean", "__period_mean"


@dataclass
class TrainedProvider:
    """A provider whose scores need the tables of means, so it scores rows, not expressions."""

    model_version: str
    dataset_version: str
    units: DataFrame
    periods: DataFrame
    mean: float | None
    model: PipelineModel | None
    provider: str = "trained"
    description: str = "Linear model of what a unit and a period have shown before."

    @classmethod
    def fit(cls, events: DataFrame, unit: Column, period: Column, target: Column, model_version: str, dataset_version: str) -> TrainedProvider:
        rows = events.select(unit.cast("string").alias("unit"), period.cast("string").alias("period"), target.cast("double").alias("label")).dropna()
        units = rows.groupBy("unit").agg(F.avg("label").alias(_UNIT))
        periods = rows.groupBy("period").agg(F.avg("label").alias(_PERIOD))
        mean = rows.agg(F.avg("label")).first()[0]
        model = None
        if mean is not None:
            steps = [VectorAssembler(inputCols=[_UNIT, _PERIOD], outputCol="features"), LinearRegression(solver="normal", regParam=0.0, predictionCol="__value")]
            model = Pipeline(stages=steps).fit(rows.join(units, "unit").join(periods, "period"))
        return cls(model_version, dataset_version, units, periods, mean, model)

    def score_rows(self, df: DataFrame, unit: str, period: str) -> DataFrame:
        """df with value and label."""
        if self.model is None:
            return df.withColumns({"value": F.lit(None).cast("double"), "label": F.lit(None).cast("string")})
        units = self.units.select(F.col("unit").alias("__unit"), _UNIT)
        periods = self.periods.select(F.col("period").alias("__period"), _PERIOD)
        rows = df.join(units, F.col(unit).cast("string") == F.col("__unit"), "left").join(periods, F.col(period).cast("string") == F.col("__period"), "left")
        rows = self.model.transform(rows.fillna(self.mean, [_UNIT, _PERIOD]))
        value = F.round(F.least(F.greatest(F.col("__value"), F.lit(0.0)), F.lit(1.0)), 4)
        rows = rows.withColumn("value", F.when(F.col(unit).isNotNull() & F.col(period).isNotNull(), value))
        return rows.withColumn("label", F.when(F.col("value").isNotNull(), bucket(F.col("value")))).select(*[F.col(f"`{c}`") for c in df.columns], "value", "label")

    def save(self, path: str) -> None:
        spark, at = self.units.sparkSession, f"{path}/{self.model_version}"
        self.units.write.mode("overwrite").parquet(f"{at}/units")
        self.periods.write.mode("overwrite").parquet(f"{at}/periods")
        facts = [(self.provider, self.model_version, self.dataset_version, self.mean, self.description)]
        spark.createDataFrame(facts, "provider string, model_version string, dataset_version string, mean double, description string").write.mode("overwrite").parquet(f"{at}/facts")
        if self.model is not None:
            self.model.write().overwrite().save(f"{at}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str, model_version: str) -> TrainedProvider:
        at = f"{path}/{model_version}"
        facts = spark.read.parquet(f"{at}/facts").first()
        model = PipelineModel.load(f"{at}/model") if facts["mean"] is not None else None
        return cls(facts["model_version"], facts["dataset_version"], spark.read.parquet(f"{at}/units"), spark.read.parquet(f"{at}/periods"), facts["mean"], model, facts["provider"], facts["description"])

"""Scoring and windowed counts on streams (beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import ScoreProvider
from ..operators.risk import scored


def scored_stream(stream: DataFrame, provider: ScoreProvider | None = None) -> DataFrame:
    """A stream of (spatial_unit_id, period_id) with scores; stateless, so the batch operator serves."""
    return scored(stream, provider)


def windowed_counts(stream: DataFrame, time: str, by: str, counts: dict[str, Column | None], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Conditional counts per group and tumbling window; state is dropped once the watermark passes a window."""
    groups = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(by))
    return groups.agg(*[(F.count("*") if c is None else F.count_if(c)).alias(n) for n, c in counts.items()])

"""Risk scores and what a map shows of them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class ScoreProvider(Protocol):
    """What a trained model has to offer to take the place of the hash score."""

    provider: str
    model_version: str
    dataset_version: str

    def score(self, unit: Column, period: Column) -> Column: ...


def hash_score(unit: Column, period: Column) -> Column:
    """0 to 1, four places: the first 64 bits of SHA-256 of unit and period, over their largest value."""
    digest = F.sha2(F.concat(unit, F.lit("|"), period), 256)
    return F.round(F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551615.0), 4)


class HashProvider:
    """The default provider; its three names are fixed values."""

    provider = "default"
    model_version = "development"
    dataset_version = "unconfigured"
    description = "Risk scoring provider used by the application."

    def score(self, unit: Column, period: Column) -> Column:
        return hash_score(unit, period)


def bucket(value: Column) -> Column:
    """none, low, mid or high."""
    return F.when(value.isNull(), "none").when(value < 0.33, "low").when(value < 0.66, "mid").otherwise("high")


def color(value: Column) -> Column:
    """The map's colour of a score; fixed values."""
    return F.when(value.isNull(), "#64748b").when(value < 0.33, "#0f766e").when(value < 0.66, "#d97706").otherwise("#b91c1c")


def radius(value: Column, selected: Column | None = None) -> Column:
    """The map's marker radius: 9 to 20 by score, 10 without one, 3 more when selected."""
    out = F.coalesce(F.lit(9.0) + value * 11, F.lit(10.0))
    return out if selected is None else out + F.when(selected, 3.0).otherwise(0.0)


def shown(value: Column) -> Column:
    """Four places, or "No value"."""
    return F.when(value.isNull(), "No value").otherwise(F.format_string("%.4f", value))

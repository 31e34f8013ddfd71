"""Dates and times in text."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import text

ISO = (
    r"^(?!0000)(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?)"
    r"(?:Z|[+-](?:[01]\d|2[0-3]):?(?:[0-5]\d)?(?::[0-5]\d)?)?)?$"
)
#: Formats in the order of their trial, with the shape each needs and their name in Python.
FORMATS = (
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/(?!0000)\d{4}$", "%d/%m/%Y"),
    ("yyyy/M/d", r"^(?!0000)\d{4}/\d{1,2}/\d{1,2}$", "%Y/%m/%d"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-(?!0000)\d{4}$", "%d-%m-%Y"),
    ("yyyy-M-d", r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"),
    ("d/M/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/(?!0000)\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "%d/%m/%Y %H:%M:%S"),
    ("yyyy/M/d H:m:s", r"^(?!0000)\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "%Y/%m/%d %H:%M:%S"),
)


def _formatted(c: Column, formats: tuple) -> Column:
    return F.coalesce(*[F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")) for pattern, shape, _ in formats])


def parse_datetime(c: Column) -> Column:
    """Wall-clock time of a stripped text, ISO first, then FORMATS; offsets are dropped. Null where it is none."""
    day, clock = F.regexp_extract(c, ISO, 1), F.replace(F.regexp_extract(c, ISO, 2), F.lit(","), F.lit("."))
    iso = F.when(c.rlike(ISO), F.when(clock == "", day).otherwise(F.concat(day, F.lit("T"), F.when(F.length(clock) == 2, F.concat(clock, F.lit(":00"))).otherwise(clock))).try_cast("timestamp_ntz"))
    return F.coalesce(iso, _formatted(F.regexp_replace(c, r"\s+", " "), FORMATS))


@F.pandas_udf(T.TimestampNTZType())
def _rare(values: pd.Series) -> pd.Series:
    """ISO forms that the expression leaves: compact, by week, with other separators."""

    def parsed(v: str | None) -> datetime | None:
        if v is None:
            return None
        try:
            return datetime.fromisoformat(v.replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            return None

    return pd.Series([parsed(v) for v in values], dtype="datetime64[us]")


def with_rare(plain: Column, c: Column) -> Column:
    """`plain`, which is `parse_datetime` of c, or the rarer ISO forms through Python; only texts that could be such are sent there."""
    rare = F.when(plain.isNull() & c.rlike(r"^\d{4}") & c.rlike(r"^[\x21-\x7e][\x20-\x7e]{6,40}$"), c)
    return F.coalesce(plain, _rare(rare))


def parse_datetime_full(c: Column) -> Column:
    """`parse_datetime` and the rarer ISO forms. Where c is dear to parse, make a column of its plain form first and use `with_rare`."""
    return with_rare(parse_datetime(c), c)


def iso_date(c: Column, typed: Column | None = None) -> Column:
    """A date cell as yyyy-MM-dd; text of no known format stays (collapsed). `typed`: the cell is a date by type."""
    raw = text(c)
    four = tuple(f for f in FORMATS if ":" not in f[0])
    out = F.coalesce(F.date_format(_formatted(raw, four), "yyyy-MM-dd"), raw)
    return out if typed is None else F.when(typed, F.substring(c, 1, 10)).otherwise(out)


def iso_time(c: Column, dated: Column | None = None, timed: Column | None = None) -> Column:
    """A time cell as HH:MM:SS; text stays (collapsed). `dated`, `timed`: the cell is a date or a time by type."""
    out = text(c)
    if timed is not None:
        out = F.when(timed, F.substring(c, 1, 8)).otherwise(out)
    return out if dated is None else F.when(dated, F.substring(c, 12, 8)).otherwise(out)


def date_parts(c: Column) -> tuple[Column, Column, Column]:
    """Year, month, day of an ISO date text (dashed, compact or by week) as texts; empty where it is none."""
    shaped = F.when(c.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}$"), c).when(
        c.rlike(r"^(?!0000)\d{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    )
    week = F.regexp_extract(c, r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$", 2)
    year = F.regexp_extract(c, r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$", 1)
    weekday = F.regexp_extract(c, r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$", 3)
    fourth = F.concat(year, F.lit("-01-04")).try_cast("date")
    monday = F.date_sub(fourth, F.weekday(fourth))
    by_week = F.date_add(monday, (week.try_cast("int") - 1) * 7 + F.coalesce(weekday.try_cast("int"), F.lit(1)) - 1)
    last = F.weekofyear(F.concat(year, F.lit("-12-28")).try_cast("date"))
    by_week = F.when((week != "") & (year != "0000") & week.try_cast("int").between(1, last) & (F.length(c).isin(7, 8, 10)), by_week)
    day = F.coalesce(shaped.try_cast("date"), by_week)
    return tuple(F.coalesce(F.date_format(day, p), F.lit("")) for p in ("y", "MM", "dd"))

"""One row for each crash that involves pedestrians, from crash and person records.

People are filtered and counted per crash before the join, so the join's right side has one row per crash;
on a large input the partial counts run before the shuffle and adaptive execution chooses the join.
"""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_parts, iso_date, iso_time
from ..functions.numbers import integer, number
from ..functions.text import display, key, text
from ..sources.files import exists
from ..sources.sinks import write_csv
from ..sources.xlsx import DATES, ROW, TIMES, records

CRASH_BOOK, CRASH_SHEET = "fatal_crashes_2021_2025.xlsx", "SINIESTROS"
PEOPLE_BOOK, PEOPLE_SHEET = "people_fatal_crashes_2021_2025.xlsx", "PERSONAS INVOLUCRADAS"
#: Output columns in order, with the header key they come from and how ("" for those derived).
COLUMNS = (
    ("crash_id", "CODIGO SINIESTRO", "text"),
    ("crash_date", "FECHA SINIESTRO", "date"),
    ("crash_time", "HORA SINIESTRO", "time"),
    ("year", "", ""),
    ("month", "", ""),
    ("day", "", ""),
    ("district", "DISTRITO", "text"),
    ("latitude", "COORDENADAS LATITUD", "number"),
    ("longitude", "COORDENADAS LONGITUD", "number"),
    ("crash_class", "CLASE SINIESTRO", "text"),
    ("fatalities_total", "CANTIDAD DE FALLECIDOS", "integer"),
    ("injured_total", "CANTIDAD DE LESIONADOS", "integer"),
    ("vehicles_damaged", "CANTIDAD DE VEHICULOS DANADOS", "integer"),
    ("pedestrians_involved", "", ""),
    ("pedestrian_fatalities", "", ""),
    ("pedestrian_injured", "", ""),
    ("zone", "ZONA", "text"),
    ("road_type", "TIPO DE VIA", "text"),
    ("road_network", "RED VIAL", "text"),
    ("road_code", "COD CARRETERA", "text"),
    ("weather_condition", "CONDICION CLIMATICA", "text"),
    ("zoning", "ZONIFICACION", "text"),
    ("road_characteristics", "CARACTERISTICAS DE VIA", "text"),
    ("road_longitudinal_profile", "PERFIL LONGITUDINAL VIA", "text"),
    ("road_surface", "SUPERFICIE DE CALZADA", "text"),
    ("vertical_sign_exists", "EXISTE SENAL VERTICAL", "text"),
    ("horizontal_sign_exists", "EXISTE SENAL HORIZONTAL", "text"),
    ("main_cause", "CAUSA FACTOR PRINCIPAL", "text"),
    ("specific_cause", "CAUSA ESPECIFICA", "text"),
)
KEY = "CODIGO SINIESTRO"
ORDER = ("crash_date", "crash_time", "crash_id")


def _cell(df: DataFrame, name: str) -> Column:
    """A column by header key; null where the sheet lacks it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _tagged(df: DataFrame, tags: str, name: str) -> Column:
    return F.coalesce(F.array_contains(tags, name), F.lit(False)) if tags in df.columns else F.lit(False)


def metropolitan(df: DataFrame) -> DataFrame:
    """Rows of the capital's province that have a crash id."""
    rows = df.where(display(_cell(df, KEY)) != "")
    return rows.where((key(_cell(df, "DEPARTAMENTO")) == "LIMA") & (key(_cell(df, "PROVINCIA")) == "LIMA"))


def conditional_counts(df: DataFrame, by: Column, counts: dict[str, Column | None]) -> DataFrame:
    """Per group: rows for which each condition holds (all rows where it is None)."""
    return df.groupBy(by).agg(*[(F.count("*") if c is None else F.count_if(c)).alias(n) for n, c in counts.items()])


def involving(df: DataFrame, people: DataFrame, on: str) -> DataFrame:
    """Rows of df that some of the people belong to, each once; where only that matters and no count, nothing is grouped."""
    return df.join(people.select(on), on, "left_semi")


def pedestrian_counts(people: DataFrame) -> DataFrame:
    """Per crash: pedestrians involved, killed and injured."""
    people = metropolitan(people)
    people = people.where(key(_cell(people, "TIPO PERSONA")) == "PEATON")
    people = people.select(text(_cell(people, KEY)).alias("crash_id"), key(_cell(people, "GRAVEDAD")).alias("severity"))
    counts = {"pedestrians_involved": None, "pedestrian_fatalities": F.col("severity") == "FALLECIDO", "pedestrian_injured": F.col("severity") == "LESIONADO"}
    return conditional_counts(people, F.col("crash_id"), counts)


def build_events(crashes: DataFrame, people: DataFrame, ordered: bool = True) -> DataFrame:
    """The event table; crashes without pedestrians go, repeated crash rows each stay.

    In order, rows of equal date, time and id stay in the order of the sheet, where the crashes carry their row's number.
    """
    crashes = metropolitan(crashes)
    how = {
        "text": lambda n: text(_cell(crashes, n)),
        "number": lambda n: number(_cell(crashes, n)),
        "integer": lambda n: integer(_cell(crashes, n)),
        "date": lambda n: iso_date(_cell(crashes, n), _tagged(crashes, DATES, n)),
        "time": lambda n: iso_time(_cell(crashes, n), _tagged(crashes, DATES, n), _tagged(crashes, TIMES, n)),
    }
    numbered = [ROW] if ROW in crashes.columns else []
    rows = crashes.select(*[how[kind](source).alias(out) for out, source, kind in COLUMNS if kind], *numbered)
    rows = rows.join(pedestrian_counts(people), "crash_id")
    year, month, day = date_parts(F.col("crash_date"))
    rows = rows.withColumns({"year": year, "month": month, "day": day})
    return (rows.orderBy(*ORDER, *numbered) if ordered else rows).select([out for out, _, _ in COLUMNS])


def valid_point(latitude: Column, longitude: Column) -> Column:
    """Both coordinates there and on the globe."""
    return F.coalesce(latitude.between(-90, 90) & longitude.between(-180, 180), F.lit(False))


def summarise(events: DataFrame) -> DataFrame:
    """One row: events, those with valid coordinates, pedestrians killed and injured."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return events.agg(
        F.count("*").alias("rows"),
        F.count_if(valid_point(F.col("latitude"), F.col("longitude"))).alias("valid_coordinate_rows"),
        total("pedestrian_fatalities"),
        total("pedestrian_injured"),
    )


def by_year(events: DataFrame) -> DataFrame:
    """Events of each known year, in order."""
    return events.where(F.col("year") != "").groupBy("year").agg(F.count("*").alias("events")).orderBy("year")


def build_files(spark: SparkSession, raw_dir: str | Path, output: str | Path) -> dict[str, Any]:
    """Reads both workbooks of a directory, writes the event file, returns its summary."""
    paths = [Path(raw_dir) / name for name in (CRASH_BOOK, PEOPLE_BOOK)]
    for path in paths:
        if not exists(spark, path):
            raise FileNotFoundError(path)
    events = build_events(*[records(spark, str(p), sheet, required=(KEY,)) for p, sheet in zip(paths, (CRASH_SHEET, PEOPLE_SHEET))]).persist()
    try:
        write_csv(events, output)
        years = {r["year"]: r["events"] for r in by_year(events).collect()}
        return summarise(events).first().asDict() | {"by_year": years, "output": str(output)}
    finally:
        events.unpersist()

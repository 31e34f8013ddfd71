"""Data-quality profile of any table of texts.

The columns are unpivoted and grouped by value first, so each distinct value is classified once, in
parallel, and every measure is a weighted sum over distinct values. Only one row a column leaves the
executors. Order-dependent measures (samples, the cap's flag) use the ordinal of the scan.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..functions.dates import parse_datetime, with_rare
from ..functions.text import header_name, is_boolean_token, is_null_token, strip
from ..session import shared_dir
from ..sources import delimited, files
from .events import valid_point

#: Limits and thresholds, and the names of coordinate columns.
UNIQUE_CAP = 100_000
SAMPLES = 5
CONFIDENCE = 0.90
LATITUDE_NAMES = ("lat", "latitude", "latitud")
LONGITUDE_NAMES = ("lon", "lng", "long", "longitude", "longitud")


def distinct_values(df: DataFrame, columns: list[str], ordinal: Column | str, more: dict[int, Column] | None = None) -> DataFrame:
    """pos, value (stripped; null for null tokens), cnt, first and last ordinal of every distinct value of every column.

    `more` has values of whole rows by position, which are counted on the way.
    """
    values = dict(enumerate(F.col(f"`{c}`").cast("string") for c in columns)) | (more or {})
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), v.alias("v")) for i, v in values.items()])
    long = df.select((F.col(ordinal) if isinstance(ordinal, str) else ordinal).alias("o"), F.explode(cells).alias("cell")).select("o", "cell.*")
    long = long.select("pos", "o", F.when(~is_null_token(F.col("v")), strip(F.col("v"))).alias("value"))
    return long.groupBy("pos", "value").agg(F.count("*").alias("cnt"), F.min("o").alias("first"), F.max("o").alias("last"))


def first_values(values: DataFrame, n: int = SAMPLES) -> DataFrame:
    """pos and the first n values of each column; each task passes on n rows a column at most."""
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("first"))
    few = values.where(F.col("value").isNotNull()).withColumn("rank", rank).where(f"rank <= {n}")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return few.groupBy("pos").agg(F.transform(ordered, lambda s: s["value"]).alias("sample_values"))


def classify(values: DataFrame, full: bool = True) -> DataFrame:
    """Adds kind (boolean, integer, float, datetime, string; null for null), num and ts. `full`: the rarer ISO dates too."""
    v = F.col("value")
    text = F.when(~numbers.is_float(v) & ~is_boolean_token(v), v)
    values = values.withColumn("ts", parse_datetime(text))
    if full:
        values = values.withColumn("ts", with_rare(F.col("ts"), text))
    kind = (
        F.when(v.isNull(), F.lit(None))
        .when(is_boolean_token(v), "boolean")
        .when(numbers.is_integer(v), "integer")
        .when(numbers.is_float(v), "float")
        .when(F.col("ts").isNotNull(), "datetime")
        .otherwise("string")
    )
    num = F.when(~is_boolean_token(v), numbers.value(v))
    return values.select("*", kind.alias("kind"), F.when(~F.isnan(num), num).alias("num"))


def infer(n: Column, boolean: Column, numeric: Column, dates: Column, floats: Column) -> tuple[Column, Column]:
    """Type of a column and percent parsed: the largest family if it has CONFIDENCE of the values; ties in the order given."""
    best = F.greatest(boolean, numeric, dates)
    sure = F.try_divide(best, n) >= CONFIDENCE
    kind = (
        F.when(n == 0, "empty")
        .when(~sure, "string")
        .when(boolean == best, "boolean")
        .when(numeric == best, F.when(floats > 0, "float").otherwise("integer"))
        .otherwise("datetime")
    )
    return kind, F.when((n > 0) & sure, F.bround(F.try_divide(best, n) * 100, 2))


def column_profiles(df: DataFrame, columns: list[str], ordinal: Column | str, full: bool = True, cap: int | None = UNIQUE_CAP) -> DataFrame:
    """One row a column, in order: counts, type, range and samples (see `profile_file` for their names)."""
    return profiles(distinct_values(df, columns, ordinal), full, cap)


def profiles(distinct: DataFrame, full: bool = True, cap: int | None = UNIQUE_CAP) -> DataFrame:
    """`column_profiles` of distinct values. All of these are counted; `cap` is what the counts shown stop at, None: nothing."""
    values = classify(distinct, full)
    known = F.col("value").isNotNull()
    weight = lambda c: F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0))
    out = values.groupBy("pos").agg(
        weight(known).alias("non_null_count"),
        weight(~known).alias("null_count"),
        F.count_if(known).alias("distinct"),
        F.max(F.when(known, F.col("first"))).alias("last_new"),
        F.max(F.when(known, F.col("last"))).alias("last_any"),
        *[weight(F.col("kind") == k).alias(k) for k in ("boolean", "integer", "float", "datetime", "string")],
        F.min("num").alias("num_min"),
        F.max("num").alias("num_max"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
    )
    out = out.join(first_values(distinct), "pos", "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    kind, pct = infer(F.col("non_null_count"), F.col("boolean"), F.col("integer") + F.col("float"), F.col("datetime"), F.col("float"))
    # The cap is reached for good once another value follows the one that filled it.
    capped = F.lit(False) if cap is None else (F.col("distinct") > cap) | ((F.col("distinct") == cap) & (F.col("last_any") > F.col("last_new")))
    unique = F.col("distinct") if cap is None else F.least("distinct", F.lit(cap))
    return out.select(
        "pos",
        kind.alias("inferred_type"),
        "non_null_count",
        "null_count",
        numbers.percent(F.col("null_count"), F.col("non_null_count") + F.col("null_count")).alias("null_pct"),
        unique.alias("unique_count"),
        F.coalesce(capped, F.lit(False)).alias("unique_count_is_capped"),
        pct.alias("parse_success_pct"),
        *["boolean", "integer", "float", "datetime", "string", "num_min", "num_max", "ts_min", "ts_max", "sample_values"],
    ).orderBy("pos")


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's stripped values and their lengths, null and empty alike."""
    values = [F.coalesce(strip(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws(",", *[x for v in values for x in (F.length(v).cast("string"), v)]), 256)


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: row_count, and duplicate_row_count by stripped values, null and empty alike.

    Rows are told apart by SHA-256 of their values with their lengths, so 32 bytes of a row are shuffled, however long it is.
    """
    groups = df.select(F.unhex(row_digest(columns)).alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"))


def coordinate_flags(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Whether both coordinates are there, and whether they are on the globe."""
    paired = ~is_null_token(latitude) & ~is_null_token(longitude)
    return paired, paired & valid_point(numbers.number(latitude), numbers.number(longitude))


def coordinate_counts(df: DataFrame, latitude: Column, longitude: Column) -> DataFrame:
    """One row: pairs of coordinates that are both there, those on the globe, and the percentage."""
    paired, valid = coordinate_flags(latitude, longitude)
    out = df.agg(F.count_if(paired).alias("paired_non_null_count"), F.count_if(valid).alias("valid_coordinate_count"))
    return out.withColumn("valid_coordinate_pct", numbers.percent(F.col("valid_coordinate_count"), F.col("paired_non_null_count")))


def coordinate_columns(names: list[str]) -> tuple[int | None, int | None]:
    """Places of the first latitude and the first longitude column by name."""
    found = [next((i for i, n in enumerate(names) if header_name(n) in known), None) for known in (LATITUDE_NAMES, LONGITUDE_NAMES)]
    return found[0], found[1]


def shown_number(x: float | None) -> str | None:
    """Whole numbers without a point, others with up to twelve digits."""
    if x is None:
        return None
    if x in (float("inf"), float("-inf")):
        return format(x, "g")
    return str(int(x)) if x == int(x) else format(x, ".12g")


@F.pandas_udf(T.StringType())
def shown_numbers(values: pd.Series) -> pd.Series:
    """`shown_number` of a column of doubles, batch by batch."""
    return pd.Series([shown_number(None if x is None or x != x else x) for x in values.tolist()], dtype=object)


def column_messages(name: Column, null_pct: Column, capped: Column, cap: int | None = UNIQUE_CAP) -> Column:
    """What in a column needs a look, as an array of texts, which are fixed values."""
    head = F.concat(F.lit("Column '"), name)
    null = F.when(null_pct >= 50, F.concat(head, F.lit("' is at least 50% null.")))
    return F.array_compact(F.array(null, F.when(capped, F.concat(head, F.lit(f"' unique count reached the tracking cap ({cap}).")))))


def general_messages(rows: Column, duplicates: Column, malformed: Column, valid_pct: Column, paired: Column, dated: Column) -> Column:
    """What in the whole table needs a look, as an array of texts, which are fixed values. `paired`: it has a pair of coordinate columns."""
    found = (
        F.when(rows == 0, F.lit("Dataset contains no data rows.")),
        F.when(duplicates > 0, F.format_string("Detected %d exact duplicate row(s).", duplicates)),
        F.when(malformed > 0, F.format_string("Detected %d malformed row(s) with extra fields.", malformed)),
        F.when(~paired, F.lit("No explicit latitude/longitude column pair was detected.")),
        F.when(paired & (valid_pct < 90), F.lit("Less than 90% of non-null coordinate pairs are geographically valid.")),
        F.when(~dated, F.lit("No temporal column reached the 90% datetime parse threshold.")),
    )
    return F.array_compact(F.array(*found))


def temporal(profiles: DataFrame) -> DataFrame:
    """The profiles of the columns that hold dates, in order."""
    return profiles.where("inferred_type = 'datetime'").orderBy("pos")


#: Places of what is counted of whole rows, beside the columns: the row itself, its coordinates, its extra fields.
ROW, PAIR, LONG = -1, -2, -3


def scanned(table: delimited.Table) -> DataFrame:
    """The distinct values of a table's columns and of whole rows, in one aggregation over one scan.

    Metrics observed on the way would be counted twice where a lost executor's tasks run again; an aggregation isn't.
    """
    more = {ROW: row_digest(table.columns), LONG: F.when(F.col(delimited.EXTRA).isNotNull(), F.lit("long"))}
    lat, lon = coordinate_columns(table.names)
    if lat is not None and lon is not None:
        paired, valid = coordinate_flags(F.col(f"c{lat}"), F.col(f"c{lon}"))
        more[PAIR] = F.when(valid, F.lit("valid")).when(paired, F.lit("invalid"))
    return distinct_values(table.rows, table.columns, delimited.ORDINAL, more)


def profile_file(spark: SparkSession, path: str | Path, delimiter: str | None = None, encoding: str = "utf-8-sig", now: datetime | None = None, cap: int | None = UNIQUE_CAP) -> dict[str, Any]:
    """The whole report of a delimited file, at any path that Spark reads. `cap`: what counts of distinct values stop at; None: they are exact.

    The rows are parsed once; their distinct values are a table in the shared folder until the report is made.
    """
    table = delimited.scan(spark, path, delimiter, encoding)
    size, sha256 = files.size_and_digest(spark, path)
    folder = f"{shared_dir(spark)}/profile-{uuid.uuid4().hex}"
    try:
        scanned(table).write.parquet(folder)
        distinct = spark.read.parquet(folder)
        names = F.array(*map(F.lit, table.names))
        found = profiles(distinct.where("pos >= 0"), cap=cap).withColumn("name", F.element_at(names, F.col("pos") + 1))
        found = found.withColumn("messages", column_messages(F.col("name"), F.col("null_pct"), F.col("unique_count_is_capped"), cap))
        by_pos = {r["pos"]: r.asDict() for r in found.collect()}  # one row a column
        of = lambda pos, weight="cnt", **value: F.coalesce(F.sum(F.when((F.col("pos") == pos) & F.col("value").isin(*value["of"]) if value else F.col("pos") == pos, F.expr(weight))), F.lit(0))
        counts = distinct.where("pos < 0").agg(
            of(ROW).alias("rows"),
            of(ROW, "cnt - 1").alias("duplicates"),
            of(LONG, of=["long"]).alias("long"),
            of(PAIR, of=["valid", "invalid"]).alias("paired"),
            of(PAIR, of=["valid"]).alias("valid"),
        )
        counts = counts.withColumn("pct", numbers.percent(F.col("valid"), F.col("paired"))).first()
    finally:
        files.remove(spark, folder)
    lat, lon = coordinate_columns(table.names)
    coordinates = None
    if lat is not None and lon is not None:
        coordinates = {"latitude_column": table.names[lat], "longitude_column": table.names[lon], "paired_non_null_count": counts["paired"], "valid_coordinate_count": counts["valid"], "valid_coordinate_pct": counts["pct"]}
    bad = counts["long"]
    empty = {"inferred_type": "empty", "non_null_count": 0, "null_count": 0, "null_pct": 0.0, "unique_count": 0, "unique_count_is_capped": False, "parse_success_pct": None, "sample_values": [], "messages": []}
    columns, messages = [], []
    for i, name in enumerate(table.names):
        r = empty | by_pos.get(i, {})
        low, high = None, None
        if r["inferred_type"] in ("integer", "float"):
            low, high = shown_number(r["num_min"]), shown_number(r["num_max"])
        elif r["inferred_type"] == "datetime":
            low, high = r["ts_min"].isoformat(), r["ts_max"].isoformat()
        keep = ("inferred_type", "non_null_count", "null_count", "null_pct", "unique_count", "unique_count_is_capped", "parse_success_pct")
        columns.append({"name": name} | {k: r[k] for k in keep} | {"minimum": low, "maximum": high, "sample_values": list(r["sample_values"])})
        messages += r["messages"]
    n, duplicates = counts["rows"], counts["duplicates"]
    dates = [c["name"] for c in columns if c["inferred_type"] == "datetime"]
    valid = F.lit(coordinates and coordinates["valid_coordinate_pct"]).cast("double")
    general = general_messages(F.lit(n), F.lit(duplicates), F.lit(bad), valid, F.lit(coordinates is not None), F.lit(bool(dates)))
    return {
        "source": str(path),
        "generated_at_utc": (now or datetime.now(UTC)).isoformat(),
        "file_size_bytes": size,
        "sha256": sha256,
        "delimiter": table.delimiter,
        "row_count": n,
        "column_count": len(table.names),
        "duplicate_row_count": duplicates,
        "duplicate_row_pct": round(duplicates / n * 100, 2) if n else 0.0,
        "columns": columns,
        "coordinate_profile": coordinates,
        "temporal_candidates": dates,
        "warnings": [*spark.range(1).select(general).first()[0], *messages],
    }

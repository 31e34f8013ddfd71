import hashlib
import time
import random
from datetime import date, datetime

from pyspark.sql import functions as F

from roadglass.functions import dates, numbers, score, text


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(2)
    return [tuple(r)[1:] for r in df.select("i", *[e.alias(f"e{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()]


def test_text(spark):
    values = ["  a\t\tb \x1c c\xa0d ", None, "", "¿EXISTE  SEÑAL_X?", "nº2 PEATÓN", "ŁÓDŹ straße", "\x1f x \x1d"]
    v = F.col("v")
    got = column(spark, values, text.text(v), text.strip(v), text.display(v), text.key(v), text.key_latin(v))
    for value, (collapsed, stripped, shown, key, latin) in zip(values, got):
        assert collapsed == ("" if value is None else " ".join(value.split()))
        assert stripped == (None if value is None else value.strip())
        assert shown == ("" if value is None else value.strip())
        assert key == text.fold(value)
        if value and "º" not in value:
            assert latin == key
    assert text.fold("¿EXISTE  SEÑAL_X?") == "EXISTE SENAL X" and text.fold("nº2") == "NO2" and text.fold(None) == ""
    assert text.header_name(" LÓNGITUD ") == "longitud"


def test_tokens(spark):
    v = F.col("v")
    got = column(spark, ["NA", " n/a ", "Null", "nOne", "NaN", "", " ", None, "0", "nano"], text.is_null_token(v))
    assert [x for (x,) in got] == [True] * 8 + [False] * 2
    got = column(spark, ["TRUE", "false", "Yes", "no", "SI", "Sí", "1", "t", "y"], text.is_boolean_token(v))
    assert [x for (x,) in got] == [True] * 6 + [False] * 3


def test_numbers_as_python(spark):
    rng = random.Random(1)
    pieces = ["1", "12", "_", ".", "e", "E5", "-", "+", "inf", "nan", "Infinity", "d", "f", "0", "99", " "]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(4000)] + ["1_000", "12d", "1f", ".5", "5.", "-nan", "1e400", "9" * 30]
    v = F.col("v")
    got = column(spark, values, numbers.is_integer(text.strip(v)), numbers.is_float(text.strip(v)), numbers.number(v), numbers.integer(v))

    def py(kind, s):
        try:
            return kind(s)
        except ValueError:
            return None

    for s, (is_int, is_float, number, whole) in zip(values, got):
        want = py(float, s)
        assert is_int == (py(int, s) is not None), s
        assert is_float == (want is not None), s
        if want is not None and want == want:
            assert number == want, s
            assert whole == (int(want) if abs(want) < 2**63 else None), s
        elif want is None:
            assert number is None and whole is None, s


def test_datetimes_as_python(spark):
    rng = random.Random(2)

    def py(v):
        try:
            return datetime.fromisoformat(v.replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            pass
        for f in [f for _, _, f in dates.FORMATS]:
            try:
                return datetime.strptime(v, f)
            except ValueError:
                continue
        return None

    values = ["2025-01-01T08:00:00", "2025-01-01T08:30Z", "2025-01-01 08:30:00+05:00", "31/02/2025", "1/2/2025", "10/05/2024  08:30:00", "2025-01-01T08:30+0500", "0000-01-01", "2025", "2025-01", "20250101T0830", "2025-W01-1", "2025-01-01x08:00", "2025-01-01T08", "2024-02-29", "2023-02-29", "5-6-2020", "2020/7/8 1:2:3", "abc", "2025-01-01T08:30:00.123456", "2025-01-01T25:00:00"]
    for _ in range(1500):
        y, m, d, h = rng.choice([1999, 2024, 2025]), rng.randint(0, 13), rng.randint(0, 32), rng.randint(0, 25)
        values.append(rng.choice([f"{d}/{m}/{y}", f"{y}/{m}/{d}", f"{d:02d}-{m:02d}-{y}", f"{y}-{m:02d}-{d:02d}", f"{y}-{m}-{d}", f"{y}-{m:02d}-{d:02d}T{h:02d}:30", f"{d}/{m}/{y} {h}:5:59", f"{y}/{m}/{d} {h}:59:1", f"{y}-{m:02d}-{d:02d} {h:02d}:00:00Z"]))
    got = column(spark, values, dates.parse_datetime_full(F.col("v")))
    assert [(v, x) for v, (x,) in zip(values, got)] == [(v, py(v)) for v in values]


def test_date_cells_and_parts(spark):
    values = ["10/05/2024", "2024/05/10", "10-05-2024", "2024-5-1", "20240510", "n.d.", None, "  10/05/2024 ", "31/02/2024", "2024-05-10 00:00:00"]
    v = F.col("v")
    got = column(spark, values, dates.iso_date(v), dates.iso_time(v))
    assert [g[0] for g in got] == ["2024-05-10"] * 3 + ["2024-05-01", "20240510", "n.d.", "", "2024-05-10", "31/02/2024", "2024-05-10 00:00:00"]
    assert column(spark, ["2024-05-10 08:30:01.5"], dates.iso_date(v, F.lit(True)), dates.iso_time(v, F.lit(True)), dates.iso_time(F.lit("07:08:09.5"), F.lit(False), F.lit(True))) == [("2024-05-10", "08:30:01", "07:08:09")]
    values = ["2024-05-10", "20240510", "2024-W19-5", "2024W195", "2024-W19", "2024W19", "2024-W195", "2021-W53-1", "2020-W53-7", "2024-13-01", "2024-5-1", "", None, "0000-01-01", "2024-02-30", "0099-03-04"]
    for value, got in zip(values, column(spark, values, *dates.date_parts(v))):
        try:
            day = date.fromisoformat(value)
            want = (str(day.year), f"{day.month:02d}", f"{day.day:02d}")
        except (ValueError, TypeError):
            want = ("", "", "")
        assert got == want, value


def test_scores(spark):
    keys = [f"unit-{i}" for i in range(2000)]
    got = column(spark, keys, score.hash_score(F.col("v"), F.lit("period-a")))
    for k, (x,) in zip(keys, got):
        assert x == round(int.from_bytes(hashlib.sha256(f"{k}|period-a".encode()).digest()[:8], "big") / (2**64 - 1), 4)
    v = F.col("v").cast("double")
    got = column(spark, [None, "0.3299", "0.33", "0.66", "1"], score.bucket(v), score.color(v), score.radius(v), score.radius(v, F.lit(True)), score.shown(v))
    assert [g[0] for g in got] == ["none", "low", "mid", "high", "high"]
    assert got[0][1:] == ("#64748b", 10.0, 13.0, "No value") and got[4][1:] == ("#b91c1c", 20.0, 23.0, "1.0000")


def test_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([(a, b) for b in range(0, 60) for a in range(0, b + 1)], "a int, b int")
    for r in df.select("a", "b", numbers.percent(F.col("a"), F.col("b")).alias("p")).collect():
        assert r["p"] == round((r["a"] / r["b"] * 100) if r["b"] else 0.0, 2)


def test_key_over_all_characters(spark):
    """`key` is `fold` for every character, between letters, after a mark's base and alone; no plan has a Python worker for it."""
    values = ["".join(f"a{chr(c)}b {chr(c)} e{chr(c)}1" for c in range(k, min(k + 61, 0x110000)) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 61)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", text.key("v").alias("k"))
    assert [r["i"] for r in df.collect() if r["k"] != text.fold(values[r["i"]])] == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_event_table_without_python(spark):
    from roadglass.plans.queries import QUERIES

    plan = QUERIES["event_build"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_key_of_long_texts(spark):
    """The tables of rare characters cost a text without them next to nothing: `key` takes a few times what `key_latin` does, not twenty times."""
    v = F.concat(F.repeat(F.lit("Los años de la niña, 12 páginas y más. "), 2000), F.col("id").cast("string"))
    rows = spark.range(0, 240, 1, 4).select(v.alias("v")).localCheckpoint()

    def seconds(c):
        began = time.perf_counter()
        rows.select(F.max(F.length(c))).collect()
        return time.perf_counter() - began

    own, plain = (min(seconds(c) for _ in range(3)) for c in (text.key("v"), text.key_latin(F.col("v"))))
    assert own < 6 * plain + 1

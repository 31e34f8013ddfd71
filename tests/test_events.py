import csv
from datetime import date, datetime, time

import pytest

from roadglass import cli
from roadglass.operators import events
from roadglass.sources.xlsx import records
from tests.books import CRASH_HEADERS, crash, crash_books, write_book

PEOPLE = [
    ["LIMA-1", "LIMA", "LIMA", "ATE", "PEATÓN", "FALLECIDO"],
    ["LIMA-1", "LIMA", "LIMA", "ATE", "PEATÓN", "LESIONADO"],
    ["LIMA-1", "LIMA", "LIMA", "ATE", "CONDUCTOR", "ILESO"],
    ["LIMA-2", "LIMA", "LIMA", "ATE", "CONDUCTOR", "FALLECIDO"],
    ["CALLAO-1", "CALLAO", "CALLAO", "CALLAO", "PEATÓN", "FALLECIDO"],
]


@pytest.mark.parametrize("use_shared", [True, False])
def test_build_files(spark, tmp_path, use_shared):
    crashes = [crash("LIMA-1"), crash("LIMA-2"), crash("CALLAO-1", DEPARTAMENTO="CALLAO", PROVINCIA="CALLAO")]
    crash_books(tmp_path, crashes, PEOPLE, use_shared=use_shared)
    out = tmp_path / "deep" / "events.csv"
    got = events.build_files(spark, tmp_path, out)
    assert got == {"rows": 1, "valid_coordinate_rows": 1, "pedestrian_fatalities": 1, "pedestrian_injured": 1, "by_year": {"2024": 1}, "output": str(out)}
    raw = out.read_bytes()
    assert raw.count(b"\r\n") == 2
    (row,) = csv.DictReader(raw.decode().splitlines())
    assert list(row) == [c for c, _, _ in events.COLUMNS] and len(row) == 29
    assert (row["crash_id"], row["district"], row["crash_date"], row["pedestrians_involved"]) == ("LIMA-1", "ATE", "2024-05-10", "2")
    assert (row["crash_time"], row["month"], row["latitude"], row["vertical_sign_exists"]) == ("08:30", "05", "-12.04", "SI")


def test_join_dates_and_order(spark, tmp_path):
    """Repeated crash rows, crashes and people without the other, and dates and times of every form."""
    crashes = [
        crash("B", FECHA_SINIESTRO="10/05/2024", HORA_SINIESTRO=time(7, 5, 9)),
        crash("A", FECHA_SINIESTRO="20240511", HORA_SINIESTRO=" 08 :  30 "),
        crash("A", FECHA_SINIESTRO="20240511", HORA_SINIESTRO=datetime(2024, 1, 1, 23, 59, 58)),
        crash("C x", FECHA_SINIESTRO="n.d.", COORDENADAS_LATITUD="nan"),
        crash("D", FECHA_SINIESTRO=date(2023, 12, 31), COORDENADAS_LATITUD=95.5, CANTIDAD_DE_FALLECIDOS="2.9"),
        crash("E"),
        crash(None),
        crash("   "),
    ]
    people = [[c, "Lima", " líma ", "", "peatón", "Lesionado"] for c in ("A", "B", "C  x", "D", "D", "Z")]
    people += [["E", "LIMA", "CALLAO", "", "PEATON", "FALLECIDO"], ["D", "LIMA", "LIMA", "", "PEATÓN", "OTRO"]]
    crash_books(tmp_path, crashes, people)
    df = events.build_events(records(spark, str(tmp_path / events.CRASH_BOOK), events.CRASH_SHEET), records(spark, str(tmp_path / events.PEOPLE_BOOK), events.PEOPLE_SHEET))
    got = [(r["crash_id"], r["crash_date"], r["crash_time"], r["year"], r["month"], r["day"], r["pedestrians_involved"], r["pedestrian_injured"]) for r in df.collect()]
    assert got == [
        ("D", "2023-12-31", "08:30", "2023", "12", "31", 3, 2),
        ("B", "2024-05-10", "07:05:09", "2024", "05", "10", 1, 1),
        ("A", "20240511", "08 : 30", "2024", "05", "11", 1, 1),
        ("A", "20240511", "23:59:58", "2024", "05", "11", 1, 1),
        ("C x", "n.d.", "08:30", "", "", "", 1, 1),
    ]
    assert events.summarise(df).first().asDict() == {"rows": 5, "valid_coordinate_rows": 3, "pedestrian_fatalities": 0, "pedestrian_injured": 6}
    assert [tuple(r) for r in events.by_year(df).collect()] == [("2023", 1), ("2024", 3)]
    assert {r["crash_id"]: r["fatalities_total"] for r in df.collect()}["D"] == 2
    none = events.build_events(records(spark, str(tmp_path / events.CRASH_BOOK), events.CRASH_SHEET).limit(0), records(spark, str(tmp_path / events.PEOPLE_BOOK), events.PEOPLE_SHEET))
    assert events.summarise(none).first().asDict() == {"rows": 0, "valid_coordinate_rows": 0, "pedestrian_fatalities": 0, "pedestrian_injured": 0}


def test_missing_columns_and_repeated_headers(spark, tmp_path):
    book = write_book(tmp_path / "b.xlsx", {"S": [[], [], [], [], ["Código siniestro", "", "Zona", "ZONA "], ["X", "drop", "first", "last"], ["Y"]]})
    rows = records(spark, str(book), "S").collect()
    assert [(r["CODIGO SINIESTRO"], r["ZONA"]) for r in rows] == [("X", "last"), ("Y", None)]
    with pytest.raises(Exception, match="does not exist"):
        records(spark, str(book), "T").collect()
    short = write_book(tmp_path / "s.xlsx", {"S": [["a"]]})
    with pytest.raises(Exception, match="no row 5"):
        records(spark, str(short), "S").collect()


def test_missing_files_and_cli(spark, tmp_path, capsys):
    with pytest.raises(FileNotFoundError):
        events.build_files(spark, tmp_path, tmp_path / "o.csv")
    crash_books(tmp_path, [crash("LIMA-1")], PEOPLE)
    assert cli.main(["build", "--raw-dir", str(tmp_path), "--output", str(tmp_path / "o.csv")]) == 0
    assert "Wrote 1 events" in capsys.readouterr().out
    assert len(CRASH_HEADERS) == 25


def test_plan_filters_before_the_join(spark):
    people = spark.createDataFrame([], "`CODIGO SINIESTRO` string, DEPARTAMENTO string, PROVINCIA string, `TIPO PERSONA` string, GRAVEDAD string")
    plan = events.pedestrian_counts(people)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 or "EmptyRelation" in plan or "LocalTableScan" in plan

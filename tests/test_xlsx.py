import random
import re
import zipfile
from datetime import datetime

import pytest

from roadglass.operators import events
from roadglass.sources import sinks
from roadglass.sources.xlsx import ROW, Book, records, sample
from tests.books import crash, crash_books, write_book


@pytest.fixture
def book(tmp_path):
    rng = random.Random(4)
    rows = [["Id", "Name", "Grosse"], *[[i, rng.choice(["a", "b", "", None, "x <row r='9'> y"]), i * 0.5] if i % 11 else [] for i in range(1, 3000)]]
    return write_book(tmp_path / "b.xlsx", {"Other": [["z"]], "Data": [[], [], *rows]}), rows


def read(spark, path, size, **more):
    return records(spark, path, "Data", 3, range_bytes=size, **more)


@pytest.mark.parametrize("size", [1000, 7777, 100_000, 1 << 23])
def test_ranges_of_rows(spark, book, size):
    """Two ranges of one sheet are two tasks, and together they are the sheet."""
    path, rows = book
    df = read(spark, path, size)
    got = [(r[ROW], r["ID"], r["NAME"], r["GROSSE"]) for r in df.collect()]
    want = [(i, str(r[0]), r[1], str(r[2])) for i, r in enumerate(rows[1:], 4) if r]
    assert got == want
    whole = Book(str(path)).zip.getinfo("xl/worksheets/sheet2.xml").file_size
    assert (df.rdd.getNumPartitions() > 1) == (whole > size) and df.rdd.getNumPartitions() <= max(1, whole // size + 1)


def test_rows_without_numbers(spark, tmp_path):
    path = write_book(tmp_path / "n.xlsx", {"Data": [["a", "b"], *[[i, "v"] for i in range(500)]]})
    bare = tmp_path / "bare.xlsx"
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(bare, "w") as out:
        for n in z.namelist():
            data = z.read(n).decode()
            out.writestr(n, re.sub(r'(<row) r="\d+"', r"\1", data) if "sheet" in n else data)
    df = records(spark, bare, "Data", 1, range_bytes=900)
    assert [(r[ROW], r["A"]) for r in df.collect()] == [(i + 2, str(i)) for i in range(500)] and df.rdd.getNumPartitions() > 5


def test_limits_of_the_scan(spark, book):
    """Ranges beyond the limits are no tasks; what is left is the same as filtered afterwards, and another scan isn't touched by it."""
    path, _ = book
    every = read(spark, path, 5000)
    rows, parts = every.collect(), every.rdd.getNumPartitions()
    cases = [
        ({"last_row": 50}, lambda r: r[ROW] <= 50),
        ({"first_row": 101, "last_row": 129}, lambda r: 100 < r[ROW] < 130),
        ({"first_row": 77, "last_row": 77}, lambda r: r[ROW] == 77),
        ({"first_row": 2900}, lambda r: r[ROW] >= 2900),
        ({"last_row": 2}, lambda r: False),
        ({"first_row": 9000}, lambda r: False),
        ({"required": ("NAME",)}, lambda r: r["NAME"] is not None),
        ({"required": ("NAME", "ID"), "last_row": 700}, lambda r: r["NAME"] is not None and r[ROW] <= 700),
        ({"required": ("NO SUCH",)}, lambda r: False),
    ]
    for limits, keep in cases:
        df = read(spark, path, 5000, **limits)
        assert df.collect() == [r for r in rows if keep(r)], limits
        assert "required" in limits or df.rdd.getNumPartitions() < parts, limits
    few = every.where(f"{ROW} <= 50")
    assert few.count() < every.count() == len(rows)


def test_key_and_row_limit_in_the_scan(spark, tmp_path):
    crash_books(tmp_path, [crash("A"), crash(None), crash("  ")], [["A", "LIMA", "LIMA", "", "PEATÓN", "FALLECIDO"]])
    path = str(tmp_path / events.CRASH_BOOK)
    assert records(spark, path, events.CRASH_SHEET, required=(events.KEY,)).count() == 2
    assert events.metropolitan(records(spark, path, events.CRASH_SHEET)).count() == 1
    assert [(r["sheet"], r["row_index"]) for r in sample(spark, path, 6, 5).collect()] == [("SINIESTROS", 5), ("SINIESTROS", 6)]


def test_order_of_equal_keys(spark, tmp_path):
    """Crashes of equal date, time and id stay in the order of the sheet."""
    crashes = [crash("A", ZONA=f"zone {i:03d}") for i in range(200)]
    crash_books(tmp_path, crashes, [["A", "LIMA", "LIMA", "", "PEATÓN", "FALLECIDO"]])
    df = events.build_events(records(spark, str(tmp_path / events.CRASH_BOOK), events.CRASH_SHEET), records(spark, str(tmp_path / events.PEOPLE_BOOK), events.PEOPLE_SHEET))
    assert [r["zone"] for r in df.collect()] == [f"zone {i:03d}" for i in range(200)] and ROW not in df.columns


def test_path_with_a_scheme(spark, tmp_path):
    path = write_book(tmp_path / "s p.xlsx", {"Data": [["a"], [1]]})
    df = records(spark, f"file:{path}", "Data", 1)
    assert [r["A"] for r in df.collect()] == ["1"]


def test_written_workbook(spark, tmp_path):
    """What a table's workbook holds is read back, by this library as by the format's rules."""
    rows = [(1, " a & <b> ]]> \r\n\x01é🎉", 0.5, datetime(2024, 5, 10, 8, 30), None), (None, "", float("nan"), None, True), (-7, None, 1e-7, datetime(1999, 12, 31), False)]
    df = spark.createDataFrame(rows, "`Nº` long, Text string, x double, Day timestamp, ok boolean").coalesce(1)
    path = sinks.write_workbook(df, tmp_path / "deep" / "w.xlsx", 'S & "1"', 2)
    got = [tuple(r) for r in records(spark, path, 'S & "1"', 2).select("NO", "TEXT", "X", "DAY", "OK", ROW).collect()]
    assert got == [("1", " a & <b> ]]> \r\n\ufffdé🎉", "0.5", "2024-05-10 08:30:00", None, 3), (None, "", None, None, "True", 4), ("-7", None, "1e-07", "1999-12-31 00:00:00", "False", 5)]
    assert Book(str(path)).dimension('S & "1"') == 5
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and len(z.namelist()) == 5
    assert [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["w.xlsx"]
    with pytest.raises(ValueError, match="rows at most"):
        sinks.write_workbook(spark.range(1 << 20), tmp_path / "large.xlsx")
    assert not (tmp_path / "large.xlsx").exists()


@pytest.mark.parametrize(("rows", "size"), [(1 << 20, 1 << 23), (100, 1 << 23), (1 << 20, 4000)])
def test_folder_of_workbooks(spark, tmp_path, rows, size):
    """A path that ends in "/" takes more rows than a sheet has: sheets go on from one workbook to the next, with their rows' numbers."""
    df = spark.range(0, 2000, 1, 3).selectExpr("id as `Nº`", "if(id % 7 = 0, null, concat('<é', id)) as Text")
    path = sinks.write_workbook(df, f"{tmp_path}/many/", "S", 2, rows, size)
    books = sorted(p.name for p in (tmp_path / "many").iterdir() if p.suffix == ".xlsx")
    assert len(books) == 3 if rows == 1 << 20 and size == 1 << 23 else len(books) > 15
    for b in books:
        info = Book(f"{path}{b}").zip.getinfo("xl/worksheets/sheet1.xml")
        assert Book(f"{path}{b}").dimension("S") <= rows and info.file_size <= size
    want = [(i + 3, str(i), f"<é{i}" if i % 7 else None) for i in range(2000)]
    every = records(spark, path, "S", 2)
    assert [(r[ROW], r["NO"], r["TEXT"]) for r in every.collect()] == want and every.rdd.getNumPartitions() == len(books)
    assert [(r[ROW], r["NO"], r["TEXT"]) for r in records(spark, path, "S", 2, first_row=700, last_row=1500, required=("TEXT",), range_bytes=900).collect()] == [w for w in want if 700 <= w[0] <= 1500 and w[2]]
    assert [p.name for p in tmp_path.iterdir()] == ["many"]
    assert [(r["row_index"], r["cells"]) for r in sample(spark, path, 3).collect()] == [(1, []), (2, ["Nº", "Text"]), (3, ["0", None])]


def test_folder_of_workbooks_replaced_and_empty(spark, tmp_path):
    df = spark.range(0, 50, 1, 4).selectExpr("id as a")
    path = f"file:{tmp_path}/w/"
    sinks.write_workbook(df, path, "S", 1)
    sinks.write_workbook(df.where("id < 0"), path, "S", 1)
    assert records(spark, path, "S", 1).collect() == [] and records(spark, path, "S", 1).columns[0] == "A"
    sinks.write_workbook(df.where("id > 40"), path, "S", 1)
    assert [(r["A"], r[ROW]) for r in records(spark, path, "S", 1).collect()] == [(str(i), i - 39) for i in range(41, 50)]
    assert sample(spark, path, 1).first()["last_row"] == 1 + 9
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no .xlsx files"):
        records(spark, tmp_path / "none", "S")

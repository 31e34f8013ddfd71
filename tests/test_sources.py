import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from roadglass import cli
from roadglass.sources import delimited, files, registry, sinks
from roadglass.sources.xlsx import sample
from tests.books import write_book


def inventory_book(path):
    return write_book(
        path,
        {
            "Crashes": [["Road crash records"], ["Crash ID", "Date", "Latitude", "Longitude"], ["1", "2025-01-01", -12.0, -77.0], ["2", "2025-01-02", -12.1, -77.1]],
            "People": [["Crash ID", "Road user", "Outcome"], ["1", "Pedestrian", "Injured"]],
        },
    )


def test_inspect_workbook(spark, tmp_path):
    path = inventory_book(tmp_path / "source.xlsx")
    got = registry.inspect_workbook(spark, path)
    assert got["filename"] == "source.xlsx" and got["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest() and got["size_bytes"] == path.stat().st_size
    assert got["sheets"] == [
        {"name": "Crashes", "rows": 2, "columns": ["Crash ID", "Date", "Latitude", "Longitude"], "header_row": 2},
        {"name": "People", "rows": 1, "columns": ["Crash ID", "Road user", "Outcome"], "header_row": 1},
    ]
    assert [tuple(r) for r in registry.file_digests(spark, str(tmp_path)).select("size_bytes", "sha256").collect()] == [(got["size_bytes"], got["sha256"])]


def test_header_choice(spark, tmp_path):
    """Blank ends are cut, inner blanks stay, the first of equals wins, only 25 rows are looked at."""
    rows = [["a", "", "b", " ", None], ["c", "d"]] + [[]] * 23 + [["x", "y", "z"]]
    book = write_book(tmp_path / "h.xlsx", {"S": rows, "Empty": []})
    got = {r["name"]: (r["header_row"], r["columns"], r["rows"]) for r in registry.header_rows(sample(spark, str(book))).collect()}
    assert got["S"] == (1, ["a", "", "b"], 25)
    assert got["Empty"] == (1, [], 0)


def test_registry(spark, tmp_path):
    rows = registry.registry(spark).collect()
    assert [r["id"] for r in registry.primary(registry.registry(spark)).collect()] == ["fatal_crashes_2021_2025", "people_fatal_crashes_2021_2025"]
    assert len(rows) == 4 and all(r["url"].startswith("https://") and r["url"].endswith(".xlsx") for r in rows)
    entry = lambda i, role, f: {"id": i, "role": role, "published": "p", "filename": f, "url": "u", "scope": "s", "purpose": "t"}
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"sources": [entry("a", "primary", "1"), entry("b", "context", "2"), entry("a", "context", "3")]}, indent=1))
    assert [(r["id"], r["filename"]) for r in registry.registry(spark, str(path)).collect()] == [("a", "3"), ("b", "2")]
    assert [r["id"] for r in registry.select(registry.registry(spark, str(path)), ["b"]).collect()] == ["b"]
    path.write_text("{}")
    assert registry.registry(spark, str(path)).count() == 0


def opener(content, calls):
    def open_(request, timeout):
        calls.append((request.full_url, timeout))
        return io.BytesIO(content)

    return open_


def test_download(tmp_path):
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("x", "y")
    source, calls = {"id": "s", "filename": "s.xlsx", "url": "https://example.org/s"}, []
    target = registry.download(source, tmp_path / "d", opener=opener(good.getvalue(), calls))
    assert target.read_bytes() == good.getvalue() and calls == [("https://example.org/s", 120)]
    registry.download(source, tmp_path / "d", opener=opener(b"new", calls))
    assert len(calls) == 1
    with pytest.raises(ValueError, match="not a valid XLSX"):
        registry.download(source, tmp_path / "d", force=True, opener=opener(b"new", calls))
    assert target.read_bytes() == good.getvalue() and [p.name for p in (tmp_path / "d").iterdir()] == ["s.xlsx"]


def test_inventory_sync_and_cli(spark, tmp_path, capsys):
    content = inventory_book(tmp_path / "b.xlsx").read_bytes()
    report = tmp_path / "out" / "inventory.json"
    got = registry.sync(spark, tmp_path / "raw", report, opener=opener(content, []))
    assert [s["status"] for s in got["sources"]] == ["available"] * 2 and json.loads(report.read_text()) == got
    assert cli.main(["inspect", "--all", "--input-dir", str(tmp_path / "raw"), "--report", str(report)]) == 0
    found = json.loads(report.read_text())["sources"]
    assert [s["status"] for s in found] == ["available", "available", "missing", "missing"] and found[2] == {"source_id": "vehicles_fatal_crashes_2021_2025", "status": "missing"}
    capsys.readouterr()
    cli.main(["list"])
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 4 and lines[0].split("\t")[:3] == ["fatal_crashes_2021_2025", "primary", "2026-02-27"]


def test_sink_by_many_tasks(spark, tmp_path):
    """The frame's order is the file's; a target that is there is replaced at once; a failed write leaves nothing."""
    n = 5000
    df = spark.range(n).repartitionByRange(7, F.desc("id")).sortWithinPartitions(F.desc("id")).selectExpr("cast(id as string) as v")
    target = tmp_path / "deep" / "lines.txt"
    for uri in (target, f"file:{target}"):
        sinks.write_lines(df, uri, "head\n")
        assert target.read_text() == "head\n" + "".join(f"{i}\n" for i in reversed(range(n)))
    before = target.read_bytes()
    bad = df.select(F.when(F.col("v") == "17", F.raise_error(F.lit("no"))).otherwise(F.col("v")).alias("v"))
    with pytest.raises(Exception, match="no"):
        sinks.write_lines(bad, target)
    assert target.read_bytes() == before and [p.name for p in target.parent.iterdir() if not p.name.endswith(".crc")] == ["lines.txt"]


def test_sink_of_a_store_that_only_spark_opens(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sinks.link./out", f"file:{tmp_path}")
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "i int, s string").coalesce(1)
    sinks.write_csv(df, "viewfs://sinks/out/o.csv")
    assert (tmp_path / "o.csv").read_bytes() == b'i,s\r\n1,"a,b"\r\n2,\r\n'
    assert [tuple(r) for r in delimited.scan(spark, "viewfs://sinks/out/o.csv").rows.select("c0", "c1").collect()] == [("1", "a,b"), ("2", "")]
    assert files.size_and_digest(spark, "viewfs://sinks/out/o.csv")[0] == (tmp_path / "o.csv").stat().st_size


def test_digest_of_a_file_over_2_gb(spark, tmp_path):
    """Streamed by a task in little memory; binary rows of Spark end at 2 GB."""
    path, n = tmp_path / "large file.bin", 2_200_000_000
    with path.open("wb") as f:
        f.truncate(n)
        f.seek(1_500_000_000)
        f.write(b"somewhere")
    (tmp_path / "small").write_bytes(b"abc")
    got = {r["path"].rpartition("/")[2]: (r["size_bytes"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"large file.bin": (n, files.digest(path)), "small": (3, hashlib.sha256(b"abc").hexdigest())}


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', 1e-7, None), (2, "", -12.04, "x\ny")], "i int, s string, d double, n string").coalesce(1)
    path = sinks.write_csv(df, tmp_path / "a" / "o.csv")
    assert path.read_bytes() == b'i,s,d,n\r\n1,"a ""q"", b",1e-07,\r\n2,,-12.04,"x\ny"\r\n'
    sinks.write_csv(df.limit(0), path)
    assert path.read_bytes() == b"i,s,d,n\r\n"
    many = sinks.write_csv(df, str(tmp_path / "many") + "/")
    assert any(p.name.startswith("part-") for p in many.iterdir())

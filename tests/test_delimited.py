import csv
import io
import random

import pytest

from roadglass.sources import delimited


def expected(text, delimiter=","):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    width = len(rows[0])
    return [(i, *(r + [None] * width)[:width], len(r) - width if len(r) > width else None) for i, r in enumerate(rows[1:])]


def scanned(spark, path, **more):
    table = delimited.scan(spark, path, **more)
    rows = table.rows.select(delimited.ORDINAL, *table.columns, delimited.EXTRA)
    return sorted(tuple(r) for r in rows.collect()), rows


@pytest.fixture
def ranges(spark):
    """Splits files into ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def size(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")

    yield size
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_quotes_as_csv():
    """A line closes its record in the state machine if and only if Python's reader asks for no further line."""
    rng = random.Random(3)
    quotes = delimited.Quotes(";")
    for _ in range(20_000):
        line = "".join(rng.choice('";;a \r') for _ in range(rng.randint(1, 12))).rstrip("\r") + "\n"
        for line in io.StringIO(line, newline=""):
            for inside in (False, True):
                reader = csv.reader(iter((['"\n'] if inside else []) + [line, 'x";\n', 'y"\n', "z\n", '"\n']), delimiter=";")
                next(reader)
                assert quotes.open_after(line, inside) == (reader.line_num > 1 + inside), (line, inside)


def test_ranges_as_csv(spark, tmp_path, ranges):
    """Rows and ordinals of files with quoted breaks, doubled and stray quotes, blank lines and all line ends, in ranges of a few bytes."""
    rng = random.Random(6)
    cells = ["1", "ab", "", '"x\ny"', '"q""q"', '"a,b"', 'st"ray', '"tail" x', '"\r\n\n"', "é", '"long ' + "z\n" * 30 + '"', '"",', '"a\rb"']
    for k in range(8):
        end = ["\n", "\r\n", "\r"][k % 3]
        lines = [",".join(rng.choice(cells) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        text = "﻿a,b,c" + end + end.join(rng.choice(lines + ["", ""]) for _ in range(80)) + ["", end, ',"never closed' + end, ',"never closed'][k % 4]
        path = tmp_path / f"{k}.csv"
        path.write_bytes(text.encode())
        ranges([64, 200, 1000, 10**6][k % 4])
        got, _ = scanned(spark, path, delimiter=",")
        assert got == expected(text.removeprefix("﻿")), k


def test_as_many_tasks_as_ranges(spark, tmp_path, ranges):
    text = "a;b\n" + "".join(f'{i};"x\n{i}"\n' for i in range(3000))
    path = tmp_path / "f.csv"
    path.write_text(text)
    ranges(4000)
    got, rows = scanned(spark, path)
    assert got == expected(text, ";") and rows.rdd.getNumPartitions() >= len(text) // 4000


def test_header_of_any_length(spark, tmp_path):
    names = [f"column {i} " + "x" * 90 for i in range(20_000)]
    path = tmp_path / "wide.csv"
    path.write_text(",".join(names) + "\n" + ",".join(map(str, range(20_000))) + "\n")
    assert delimited.header(path, ",", spark=spark) == names


def test_other_encodings(spark, tmp_path, ranges):
    text = 'a,b\r\ncafé,"x\ny"\r\n\r\n1,2,3\r\n'
    ranges(16)
    for encoding in ("latin-1", "utf-8", "utf-16", "utf-16-le", "cp1252"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(text.encode(encoding))
        assert scanned(spark, path, encoding=encoding, delimiter=",")[0] == expected(text), encoding


def test_another_split_is_told(spark, tmp_path, ranges):
    path = tmp_path / "s.csv"
    path.write_text("a,b\n" + "1,2\n" * 500)
    ranges(1000)
    rows = delimited.scan(spark, path).rows
    ranges(300)
    with pytest.raises(Exception, match="scan it again"):
        rows.groupBy("c0").count().collect()

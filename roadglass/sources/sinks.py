"""Results as single files: text, delimited text and workbooks."""

from __future__ import annotations

import contextlib
import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .xlsx import RANGE_BYTES


@F.pandas_udf(T.StringType())
def _python_float(values: pd.Series) -> pd.Series:
    """Doubles as Python prints them; 1e-07, not 1.0E-7."""
    return pd.Series([None if pd.isna(v) and v is None else repr(float(v)) if v == v else None for v in values], dtype=object)


def printed(c: Column) -> Column:
    """A double as Python prints it: 0.0002, where a cast to string gives 2.0E-4."""
    return F.when(F.isnan(c), F.lit("nan")).otherwise(_python_float(c))


def _shown(c: Column, kind: str) -> Column:
    return printed(c) if kind in ("double", "float") else c


def _field(c: Column, alone: bool) -> Column:
    """A field with quotes only where it needs them."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike('[,"\\r\\n]') | ((v == "") if alone else F.lit(False)), quoted).otherwise(v)


class OneFile:
    """A file that many tasks write, at any path that Spark writes to.

    The tasks write the rows of a text column as parts, in the frame's order, into a hidden folder beside the target, under
    Spark's own commit protocol: a task that fails or is repeated leaves nothing. `commit` joins the parts behind a head and
    gives the whole the target's name in one step; `abort` removes everything. Where the file system can join files itself
    (HDFS), no bytes move; elsewhere a file has one writer, so they pass through the driver's JVM, a buffer at a time.
    """

    BUFFER = 1 << 20

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.target = self.jvm.org.apache.hadoop.fs.Path(str(path))
        self.fs = self.target.getFileSystem(self.conf)
        self.target = self.fs.makeQualified(self.target)
        self.folder = self._path(self.target.getParent(), f".{self.target.getName()}-{uuid.uuid4().hex}")

    def _path(self, *parts):
        return self.jvm.org.apache.hadoop.fs.Path(*parts)

    def write(self, lines: DataFrame, end: str) -> None:
        lines.write.option("lineSep", end).text(self._path(self.folder, "parts").toString())

    def commit(self, head: bytes, keep: bool = False) -> None:
        """Joins the parts behind the head under the target's name. `keep`: what else is in the folder stays."""
        found = [f.getPath() for f in self.fs.listStatus(self._path(self.folder, "parts")) if f.getLen() and re.match(r"part-\d+", f.getPath().getName())]
        parts = sorted(found, key=lambda p: int(re.match(r"part-(\d+)", p.getName())[1]))
        whole = self._path(self.folder, "whole")
        with contextlib.closing(self.fs.create(whole)) as out:
            out.write(bytearray(head))
        if parts and not self._concat(whole, parts):
            with contextlib.closing(self.fs.create(whole, True)) as out:
                out.write(bytearray(head))
                for part in parts:
                    with contextlib.closing(self.fs.open(part)) as own:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, self.BUFFER, False)
        self.rename(whole)
        if not keep:
            self.abort()

    def rename(self, whole) -> None:
        """Gives a file the target's name, in one step, whatever has it."""
        how = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.target.toUri(), self.conf).rename(whole, self.target, how)

    def _concat(self, whole, parts: list) -> bool:
        """Whether the file system has joined the parts to the whole by itself."""
        some = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Path, len(parts))
        for i, part in enumerate(parts):
            some[i] = part
        try:
            self.fs.concat(whole, some)
        except UnsupportedOperationException:
            return False
        return True

    def abort(self) -> None:
        self.fs.delete(self.folder, True)


def write_lines(lines: DataFrame, path: str | Path, head: str = "", end: str = "\n") -> str | Path:
    """One file of a head and the rows of a text column, each with its end, in the frame's order; replaces what is there."""
    sink = OneFile(lines.sparkSession, path)
    try:
        sink.write(lines, end)
        sink.commit(head.encode())
    except BaseException:
        sink.abort()
        raise
    return path


def write_csv(df: DataFrame, path: str | Path) -> str | Path:
    """One file with a header, CRLF line ends, minimal quotes and empty fields for nulls; replaces what is there.

    Any path that Spark writes to. A path to a directory-like target (ending in "/") keeps Spark's many part files.
    """
    rows = df.select([_shown(F.col(f"`{n}`"), kind).alias(n) for n, kind in df.dtypes])
    if str(path).endswith("/"):
        options = {"header": True, "nullValue": "", "emptyValue": "", "quote": '"', "escape": '"', "lineSep": "\r\n"}
        rows.write.mode("overwrite").options(**options).csv(str(path))
        return Path(path)
    fields = [_field(F.col(f"`{n}`"), len(df.columns) == 1) for n in df.columns]
    head = io.StringIO()
    csv.writer(head).writerow(df.columns)
    return write_lines(rows.select(F.concat_ws(",", *fields)), path, head.getvalue(), "\r\n")


#: What a workbook file holds beside its sheet, and the rows that a sheet has at most.
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
SHEET_ROWS = 1 << 20
#: Of the XML of a sheet in a folder of workbooks: a range of the scan.
BOOK_BYTES = RANGE_BYTES


def _escaped(v: Column) -> Column:
    """Text for XML; characters that XML doesn't have become U+FFFD."""
    v = F.regexp_replace(v, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\ufffe\uffff]", "\ufffd")
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), ("\n", "&#10;")):
        v = F.replace(v, F.lit(c), F.lit(name))
    return v


def _cell(c: Column, kind: str) -> Column:
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        number = F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>"))
        return F.when(c.isNull() | (F.isnan(c) if kind in ("float", "double") else F.lit(False)), F.lit("<c/>")).otherwise(number)
    if kind == "boolean":
        return F.coalesce(F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>")), F.lit("<c/>"))
    if kind in ("date", "timestamp"):
        v, before = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), '<c t="d"><v>'
        return F.coalesce(F.concat(F.lit(before), v, F.lit("</v></c>")), F.lit("<c/>"))
    text = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _escaped(c.cast("string")), F.lit("</t></is></c>"))
    return F.coalesce(text, F.lit("<c/>"))


def _letters(n: int) -> str:
    """The name of the n-th column of a sheet."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


class _Stream(io.RawIOBase):
    """A Hadoop output stream as a file that is only written on."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytearray(data))
        return len(data)


def _opening(sheet_columns: int, last: int, header_row: int, head: str) -> bytes:
    """A sheet's XML up to its rows."""
    first = f'<worksheet {_NS}><dimension ref="A1:{_letters(sheet_columns)}{last}"/><sheetData>'
    return f"{first}{'<row/>' * (header_row - 1)}<row>{head}</row>\n".encode()


def _pack(out, sheet: str, pieces: Iterable[bytes]) -> None:
    """A workbook of one sheet, whose XML comes piece by piece up to the end of its rows."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, text)
        z.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="{_RELS}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as own:
            for data in pieces:
                own.write(data)
            own.write(b"</sheetData></worksheet>")


def _cuts(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[list[bytes]]:
    """Lines in groups of at most so many, and of at most so many bytes unless one line is longer."""
    some, held = [], 0
    for batch in batches:
        for line in batch.column(0).cast(pa.binary()).to_pylist():
            if some and (len(some) == rows or held + len(line) + 1 > size):
                yield some
                some, held = [], 0
            some.append(line)
            held += len(line) + 1
    if some:
        yield some


def _books(folder: str, sheet: str, columns: int, header_row: int, head: str, rows: int, size: int):
    """Rows of cells to workbooks, which each task writes itself; the name of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        room = size - len(_opening(columns, SHEET_ROWS, header_row, head)) - 100
        for i, some in enumerate(_cuts(batches, rows - header_row, room)):
            name = f"part-{task.partitionId():06d}-{i:06d}-{task.taskAttemptId()}.xlsx"
            with files.created(f"{folder}/{name}") as out:
                _pack(out, sheet, (_opening(columns, header_row + len(some), header_row, head), b"\n".join(some)))
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def write_workbook(df: DataFrame, path: str | Path, sheet: str = "Sheet1", header_row: int = 5, rows: int = SHEET_ROWS, size: int = BOOK_BYTES) -> str | Path:
    """A workbook of one sheet with the columns' names in `header_row` and the rows under it, in the frame's order.

    Tasks write the cells; the driver only deflates what they wrote, piece by piece, as a sheet is bounded: over SHEET_ROWS
    rows raise a ValueError. Numbers, booleans, dates and moments are typed cells, the rest texts; nulls are empty cells.

    A path ending in "/" is for frames of any size: a folder of workbooks whose sheets go on from one to the next in the order
    of their names, each of at most `rows` rows, its header's included, and `size` bytes of XML, so that one task reads it.
    Tasks write them whole and only their names reach the driver; those of failed attempts are removed before the folder gets
    its name, in place of what has it. It must be at a place that `files.created` knows. `records` reads both forms alike.
    """
    spark = df.sparkSession
    kinds = df.dtypes
    head = df.sparkSession.range(1).select(F.concat(*[_cell(F.lit(n), "string") for n, _ in kinds])).first()[0]
    lines = df.select(F.concat(F.lit("<row>"), *[_cell(F.col(f"`{n}`"), kind) for n, kind in kinds], F.lit("</row>")).alias("row"))
    sink = OneFile(spark, path)
    try:
        if str(path).endswith("/"):
            sink.fs.mkdirs(sink.folder)
            found = lines.mapInArrow(_books(sink.folder.toString(), sheet, len(kinds), header_row, head, min(rows, SHEET_ROWS), size), "name string").collect()
            names = {r["name"] for r in found}
            if not names:  # a frame without rows has its header all the same
                names = {"part-000000-000000-0.xlsx"}
                with files.created(f"{sink.folder.toString()}/{min(names)}") as out:
                    _pack(out, sheet, (_opening(len(kinds), header_row, header_row, head),))
            for f in sink.fs.listStatus(sink.folder):
                if f.getPath().getName() not in names:
                    sink.fs.delete(f.getPath(), True)
            sink.fs.delete(sink.target, True)
            sink.fs.rename(sink.folder, sink.target)
            return path
        sink.write(lines, "\n")
        parts = sink._path(sink.folder, "parts").toString()
        last = header_row + spark.read.text(parts).count()
        if last > SHEET_ROWS:
            raise ValueError(f"a sheet has {SHEET_ROWS} rows at most")
        whole = OneFile(spark, sink._path(sink.folder, "sheet").toString())
        whole.folder = sink.folder
        whole.commit(_opening(len(kinds), last, header_row, head), keep=True)
        done = sink._path(sink.folder, "book")
        with contextlib.closing(sink.fs.create(done)) as out:
            _pack(_Stream(out), sheet, files.pieces(spark, whole.target.toString()))
        sink.rename(done)
    finally:
        sink.abort()
    return path

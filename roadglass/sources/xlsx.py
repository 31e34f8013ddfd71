"""Workbooks as a Python data source, on the standard library only.

`spark.read.format("workbook")` has the modes
  records  (default) the rows under a header row as texts, one column for each header key, and two arrays
           with the keys of the cells that are dates or times by type;
  raw      sheet, row_index and the cells' texts of the first `rows` rows of every sheet, and the sheet's
           last row by its stated dimension.
A cell's text is what Python prints for its value: dates as "2024-05-10 00:00:00", times as "08:30:00",
whole numbers without a point. Records carry their row's number in the sheet as ROW.

A sheet is cut into ranges of rows of about `rangeBytes` of its XML, each a partition: one pass over the inflated bytes
finds the offsets where they begin, without parsing, and a task skips to its own and parses only from there. What limits a
scan is part of it: `firstRow` and `lastRow` leave out ranges and end the reading early, `required` keys drop rows without
such a cell before they leave the reader. They are options, not pushed filters, because a frame of a Python data source
keeps what one query has pushed (Spark 4.1): a second query over it would miss the rows that the first left out.
Paths are local ones or of a store that `files.opened` knows.

A path of a folder stands for its workbooks (.xlsx) in the order of their names: a sheet goes on in the next one's of that
name, under the same header, and its rows are numbered on, by the last row that each sheet states.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import fold
from .files import listed, opened

HEADER_ROW, SCAN_ROWS = 5, 25
DATES, TIMES, ROW = "_dates", "_times", "_row"
RANGE_BYTES, CHUNK = 8 << 20, 1 << 18
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_ROW_TAG = re.compile(rb"<(?:[A-Za-z_][\w.-]*:)?row(?=[\s/>])[^>]*>")
#: Built-in number formats that show dates or times.
_DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47})


class Book:
    """The parts of a workbook that cells refer to."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(opened(path))
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {
            s.get("name"): self._part(rels[s.get(f"{_REL}id")]) for s in book.iter(f"{_MAIN}sheet") if "worksheets" in rels[s.get(f"{_REL}id")]
        }
        props = book.find(f"{_MAIN}workbookPr")
        self.epoch = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        names = set(self.zip.namelist())
        self.strings = list(self._strings()) if "xl/sharedStrings.xml" in names else []
        self.dated = self._styles() if "xl/styles.xml" in names else []

    @staticmethod
    def _part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _strings(self) -> Iterator[str]:
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_MAIN}si":
                    yield _rich(e)
                    e.clear()

    def _styles(self) -> list[bool]:
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(n.get("numFmtId")): n.get("formatCode") or "" for n in root.iter(f"{_MAIN}numFmt")}
        bare = lambda code: re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower())
        is_date = lambda k: bool(re.search(r"[dmyhs]", bare(own[k]).split(";")[0])) if k in own else k in _DATE_FORMATS
        cells = root.find(f"{_MAIN}cellXfs")
        return [is_date(int(x.get("numFmtId") or 0)) for x in cells] if cells is not None else []

    def dimension(self, sheet: str) -> int | None:
        """The last row that the sheet states."""
        with self.zip.open(self.sheets[sheet]) as f:
            for _, e in ElementTree.iterparse(f, ("start",)):
                if e.tag == f"{_MAIN}dimension":
                    m = re.search(r"(\d+)$", e.get("ref") or "")
                    return int(m[1]) if m else None
                if e.tag == f"{_MAIN}sheetData":
                    return None
        return None

    def last(self, sheet: str) -> int:
        """The sheet's last row: as stated, or as found where nothing is."""
        return self.dimension(sheet) or max((number for number, _ in self.rows(sheet)), default=0)

    def ranges(self, sheet: str, size: int = RANGE_BYTES) -> list[tuple[int, int, int | None, int]]:
        """Ranges of rows: offset of the sheet's first row, offsets of the range's first row and of its end (None: the last), the row number before.

        Offsets are of the inflated XML. A small sheet is one range, without a look at it.
        """
        if self.zip.getinfo(self.sheets[sheet]).file_size <= size:
            return [(0, 0, None, 0)]
        starts: list[tuple[int, int]] = []
        number, first, at, held = 0, 0, 0, b""
        with self.zip.open(self.sheets[sheet]) as f:
            while data := f.read(CHUNK):
                data = held + data
                cut = data.rfind(b">") + 1  # tags are looked at whole
                for m in _ROW_TAG.finditer(data, 0, cut):
                    own = re.search(rb"""\sr\s*=\s*["'](\d+)""", m.group())
                    before, number = number, int(own[1]) if own else number + 1
                    if not starts or at + m.start() - starts[-1][0] >= size:
                        starts.append((at + m.start(), before))
                at, held = at + cut, data[cut:]
        if not starts:
            return [(0, 0, None, 0)]
        first = starts[0][0]
        return [(first, a, b, before) for (a, before), b in zip(starts, [*[x for x, _ in starts[1:]], None])]

    def _bytes(self, sheet: str, part: tuple[int, int, int | None, int]) -> Iterator[bytes]:
        """What stands before the sheet's rows, then the range's rows."""
        first, start, end, _ = part
        at = 0
        with self.zip.open(self.sheets[sheet]) as f:
            while data := f.read(CHUNK):
                if at < first:
                    yield data[: first - at]
                yield data[max(0, start - at) : None if end is None else max(0, end - at)]
                at += len(data)
                if end is not None and at >= end:
                    return

    def rows(self, sheet: str, last: int | None = None, part: tuple[int, int, int | None, int] = (0, 0, None, 0)) -> Iterator[tuple[int, list[tuple[str | None, str]]]]:
        """Row number and cells (text or None; kind: "" or d, t for dates and times) of a range of rows; gaps in a row are filled."""
        number, parser, table = part[3], ElementTree.XMLPullParser(("start", "end")), None
        for data in self._bytes(sheet, part):
            parser.feed(data)
            for event, e in parser.read_events():
                if e.tag == f"{_MAIN}sheetData" and event == "start":
                    table = e
                if e.tag != f"{_MAIN}row" or event == "start":
                    continue
                number = int(e.get("r") or number + 1)
                if last and number > last:
                    return
                cells: list[tuple[str | None, str]] = []
                for c in e.iter(f"{_MAIN}c"):
                    if ref := c.get("r"):
                        at = 0
                        for ch in re.match(r"[A-Z]+", ref)[0]:
                            at = at * 26 + ord(ch) - 64
                        cells += [(None, "")] * (at - 1 - len(cells))
                    cells.append(self._cell(c))
                if table is not None:
                    table.clear()
                yield number, cells

    def _cell(self, c) -> tuple[str | None, str]:
        kind, v = c.get("t") or "n", c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            inline = c.find(f"{_MAIN}is")
            return (_rich(inline) if inline is not None else None), ""
        if v is None or v.text is None:
            return None, ""
        if kind == "s":
            return self.strings[int(v.text)], ""
        if kind == "b":
            return str(v.text.strip() in ("1", "true")), ""
        if kind == "d":
            return str(datetime.fromisoformat(v.text.replace("Z", ""))), "d"
        if kind != "n":
            return v.text, ""
        style = int(c.get("s") or 0)
        if style < len(self.dated) and self.dated[style]:
            return self._date(float(v.text))
        return (str(float(v.text)) if re.search(r"[.eE]", v.text) else str(int(v.text))), ""

    def _date(self, serial: float) -> tuple[str, str]:
        day, part = divmod(serial, 1)
        exact = timedelta(milliseconds=round(part * 86_400_000))
        if 0 <= serial < 1 and exact < timedelta(days=1):
            return str((datetime.min + exact).time()), "t"
        if 0 < serial < 60 and self.epoch.year == 1899:  # the 1900 system counts a day that never was
            day += 1
        return str(self.epoch + timedelta(days=day) + exact), "d"


def _rich(e) -> str:
    """A string's text: its own, or its runs'; phonetic hints don't count."""
    return "".join(t.text or "" for k in e for t in ([k] if k.tag == f"{_MAIN}t" else k.findall(f"{_MAIN}t") if k.tag == f"{_MAIN}r" else []))


def headers(book: Book, sheet: str, row: int) -> dict[str, int]:
    """Place of each header key; blank ones are dropped, of equal ones the last holds."""
    if sheet not in book.sheets:
        raise KeyError(f"Worksheet {sheet} does not exist.")
    for number, cells in book.rows(sheet, row):
        if number == row:
            return {k: i for i, (v, _) in enumerate(cells) if (k := fold(v))}
    raise ValueError(f"Sheet {sheet} has no row {row}")


class _Part(InputPartition):
    def __init__(self, path: str, sheet: str, rows: tuple[int, int, int | None, int], order: int, shift: int = 0):
        super().__init__((path, sheet, *rows))
        self.path, self.sheet, self.rows, self.order = path, sheet, rows, order
        #: Rows of the sheet in other workbooks: those before, or for `raw` those after.
        self.shift = shift


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.raw = options.get("mode", "records") == "raw"
        self.number = "row_index" if self.raw else ROW
        self.top = int(options.get("headerrow", options.get("headerRow", HEADER_ROW)))
        option = lambda name: options.get(name) or options.get(name.lower())
        self.least, self.most = int(option("firstRow") or 1), int(option("lastRow")) if option("lastRow") else None
        self.required = (option("required") or "").splitlines()

    def partitions(self) -> list[InputPartition]:
        paths, size = listed(self.options["path"], ".xlsx"), int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES)))
        if self.raw:  # the first rows of every sheet
            first: dict[str, str] = {}
            after: dict[str, int] = {}
            for path in paths:
                book = Book(path)
                for s in book.sheets:
                    if first.setdefault(s, path) != path:
                        after[s] = after.get(s, 0) + book.last(s) - self.top
            return [_Part(path, s, (0, 0, None, 0), i, after.get(s, 0)) for i, (s, path) in enumerate(first.items())]
        sheet, shift, every = self.options["sheet"], 0, []
        for path in paths:
            book = Book(path)
            if sheet not in book.sheets:
                raise KeyError(f"Worksheet {sheet} does not exist.")
            parts = book.ranges(sheet, size)
            last = None if path == paths[-1] else book.last(sheet)
            # A range's rows are numbered from the row before it to the next range's.
            every += [(path, p, shift, end) for p, end in zip(parts, [*[p[3] for p in parts[1:]], last])]
            shift += 0 if last is None else last - self.top
        kept = [x for x in every if (self.most is None or x[1][3] + x[2] < self.most) and (x[3] is None or x[3] + x[2] >= self.least)]
        return [_Part(path, sheet, p, i, before) for i, (path, p, before, _) in enumerate(kept or every[:1])]

    def read(self, part: _Part) -> Iterator[tuple]:
        book = Book(part.path)
        if self.raw:
            last = book.dimension(part.sheet)
            whole = last and last + part.shift
            limit = min(last or 1, int(self.options.get("rows", SCAN_ROWS)), self.most or (1 << 31))
            found = False
            for number, cells in book.rows(part.sheet, limit):
                found = True
                if number >= self.least:
                    yield part.order, part.sheet, number, [v for v, _ in cells], whole
            if not found and self.least <= 1 and (self.most is None or self.most >= 1):
                yield part.order, part.sheet, 1, [], whole
            return
        if self.most is not None and self.most < max(self.least, 1):
            return
        place, own_rows = headers(book, part.sheet, self.top), (DATES, TIMES, ROW)
        keys = [f.name for f in self.schema.fields if f.name not in own_rows]
        tail = [f.name for f in self.schema.fields if f.name in own_rows]
        for number, cells in book.rows(part.sheet, self.most and max(self.most - part.shift, 1), part.rows):
            if number <= self.top or not self.least <= number + part.shift <= (self.most or number + part.shift):
                continue
            own = {k: cells[place[k]] if k in place and place[k] < len(cells) else (None, "") for k in keys}
            if any(k not in own or own[k][0] is None for k in self.required):
                continue
            more = {DATES: [k for k, (_, t) in own.items() if t == "d"], TIMES: [k for k, (_, t) in own.items() if t == "t"], ROW: number + part.shift}
            yield (*[own[k][0] for k in keys], *[more[t] for t in tail])


class WorkbookSource(DataSource):
    """The data source; register it with `register`."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        if self.options.get("mode", "records") == "raw":
            return "sheet_order int, sheet string, row_index int, cells array<string>, last_row int"
        top = int(self.options.get("headerrow", self.options.get("headerRow", HEADER_ROW)))
        keys = headers(Book(listed(self.options["path"], ".xlsx")[0]), self.options["sheet"], top)
        tags = [T.StructField(n, T.ArrayType(T.StringType())) for n in (DATES, TIMES)]
        return T.StructType([*[T.StructField(k, T.StringType()) for k in keys], *tags, T.StructField(ROW, T.IntegerType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def _reader(spark: SparkSession, **options):
    register(spark)
    return spark.read.format("workbook").options(**{k: v for k, v in options.items() if v is not None})


def records(spark: SparkSession, path: str, sheet: str, header_row: int = HEADER_ROW, *, first_row: int | None = None, last_row: int | None = None, required: tuple[str, ...] = (), range_bytes: int | None = None) -> DataFrame:
    """The rows of one sheet by header key; of rows `first_row` to `last_row` only, and only those with a cell under each of the `required` keys."""
    return _reader(spark, sheet=sheet, headerRow=header_row, firstRow=first_row, lastRow=last_row, required="\n".join(required) or None, rangeBytes=range_bytes).load(str(path))


def sample(spark: SparkSession, path: str, rows: int = SCAN_ROWS, first_row: int | None = None) -> DataFrame:
    """The first rows of every sheet, or those from a row on."""
    return _reader(spark, mode="raw", rows=rows, firstRow=first_row).load(str(path))

"""Delimited text as strings with an ordinal, its delimiter and its malformed rows.

A file is read in ranges, by as many tasks as Spark splits it into, though quoted fields may hold line breaks. Whether
a range begins inside quotes depends on all that stands before it, so a first pass runs every range from both states
at once and gives, for each, the state it ends in and the records that begin in it. Their composition over the ranges,
one row a range on the driver, gives every range's true state and the ordinal of its first record. Then each range
parses the records that begin in it; only a record that goes on beyond its range is put together elsewhere.
"""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

SNIFFED = 8192
#: Rows of a batch that a task passes on.
BATCH = 2000
#: Messages for files that can't be read.
NO_HEADER, REPEATED_HEADER = "CSV has no header row", "CSV contains duplicate header names"
EXTRA, ORDINAL = "__extra", "__ordinal"
#: Encodings in which a line feed is one byte that is never part of another character.
_BYTEWISE = re.compile(r"(?i)utf[-_]?8|ascii|us[-_]?ascii|latin|iso[-_]?8859|cp125|windows[-_]?125|cp437|cp850|mac[-_]?roman")


def sniff(path: str | Path, encoding: str = "utf-8-sig", spark: SparkSession | None = None) -> str:
    """The delimiter of a file by its first characters; a comma where nothing speaks for another."""
    if spark is not None:
        data = files.head(spark, path, 4 * SNIFFED)
    else:
        with open(path, "rb") as f:
            data = f.read(4 * SNIFFED)
    head = codecs.getincrementaldecoder(encoding)().decode(data)[:SNIFFED]
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter if head else ","
    except csv.Error:
        return ","


def _lines(pieces: Iterable[bytes], encoding: str) -> Iterator[str]:
    """Lines with their ends (LF, CR or both), from the bytes of a file piece by piece."""
    decoder, held = codecs.getincrementaldecoder(encoding)(), ""
    for data in pieces:
        # The last line may go on, or its CR be followed by an LF.
        *whole, held = io.StringIO(held + decoder.decode(data), newline="").readlines() or [""]
        yield from whole
    yield from io.StringIO(held + decoder.decode(b"", True), newline="").readlines()


def header(path: str | Path, delimiter: str, encoding: str = "utf-8-sig", spark: SparkSession | None = None) -> list[str]:
    """The header's names, however long it is; raises ValueError if there is none or a name repeats."""
    if spark is not None:
        pieces = files.pieces(spark, path)
    else:
        pieces = [Path(path).read_bytes()]
    csv.field_size_limit(sys.maxsize)
    names = next((row for row in csv.reader(_lines(pieces, encoding), delimiter=delimiter) if row), [])
    if not names:
        raise ValueError(NO_HEADER)
    if len(set(names)) < len(names):
        raise ValueError(REPEATED_HEADER)
    return names


@dataclass
class Table:
    """Rows under the names c0, c1, ..., so that headers may differ by case only or hold any character."""

    rows: DataFrame
    names: list[str]
    delimiter: str

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.names))]


class Quotes:
    """Whether a line ends inside quotes, by the state it begins in, as Python's csv module reads it.

    Quotes count only where a field begins; after the closing quote of a field the rest of it is literal.
    """

    def __init__(self, delimiter: str):
        d = re.escape(delimiter)
        field = rf'(?:"(?:[^"]|"")*+"[^{d}\r\n]*|(?!")[^{d}\r\n]*)'
        self.whole = re.compile(rf"{field}(?:{d}{field})*[\r\n]*\Z")
        self.closing = re.compile(rf'(?:[^"]|"")*+"[^{d}\r\n]*(?:{d}{field})*[\r\n]*\Z')

    def open_after(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        return (self.closing if inside else self.whole).match(line) is None


def _split(values: pa.Array, encoding: str, first: bool) -> Iterator[str]:
    """Lines as Python's csv module reads them, from those between line feeds; a lone CR ends a line as well."""
    for v in values.to_pylist():
        text = v.decode(encoding, "replace")
        if first:
            text, first = text.removeprefix("\ufeff"), False
        text += "\n"
        if "\r" in text[:-2]:
            yield from io.StringIO(text, newline="")
        else:
            yield text


Key = tuple[int, int]


def _by_range(batches: Iterable[pa.RecordBatch], encoding: str) -> Iterator[tuple[Key, Iterator[str]]]:
    """The lines of each range (by start and length in bytes), one range after the other."""

    def stretches() -> Iterator[tuple[Key, pa.Array]]:
        for batch in batches:
            start, length = batch.column("start").to_numpy(), batch.column("length").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(start)) + 1).tolist(), len(start)]
            for a, b in itertools.pairwise(edges):
                if b > a:
                    yield (int(start[a]), int(length[a])), batch.column("value").slice(a, b - a)

    for key, own in itertools.groupby(stretches(), lambda x: x[0]):
        yield key, (line for i, (_, values) in enumerate(own) for line in _split(values, encoding, i == 0 and key[0] == 0))


class States(NamedTuple):
    """What a range does, if it begins outside (0) and inside (1) of quotes."""

    start: int
    length: int
    open0: bool
    open1: bool
    begun0: int
    begun1: int
    #: Whether the record it begins inside of ends in it.
    closed: bool


def _states(delimiter: str, encoding: str):
    """Lines to the States of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, rows = Quotes(delimiter), []

        def step(inside: bool, line: str) -> tuple[bool, int]:
            begins = int(not inside and line[0] not in "\r\n")
            return (quotes.open_after(line, inside) if inside or begins else False), begins

        for key, lines in _by_range(batches, encoding):
            outer, inner, begun0, begun1, closed = False, True, 0, 0, False
            for line in lines:
                same = outer == inner
                outer, b = step(outer, line)
                begun0 += b
                inner, b = (outer, b) if same else step(inner, line)
                begun1 += b
                closed |= not inner
            rows.append(States(*key, outer, inner, begun0, begun1, closed))
        yield pa.RecordBatch.from_pylist([r._asdict() for r in rows], _STATES)

    return run


_STATES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("open0", pa.bool_()), ("open1", pa.bool_()), ("begun0", pa.int64()), ("begun1", pa.int64()), ("closed", pa.bool_())])


class Place(NamedTuple):
    """Where a range stands in its file."""

    inside: bool
    #: The number of the first record that begins in it, and of the record it begins inside of.
    first: int
    before: int
    #: Whether the last record that begins in it goes on beyond it.
    open: bool


def places(states: Iterable[States]) -> dict[Key, Place]:
    """The place of each range, by composing the states of all before it. Record 0 is the header."""
    found, inside, n, opened = {}, False, 0, -1
    for r in sorted(states):
        begun, after = (r.begun1, r.open1) if inside else (r.begun0, r.open0)
        found[r.start, r.length] = Place(inside, n, opened, after and (not inside or r.closed))
        n += begun
        if after and (not inside or r.closed):
            opened = n - 1
        inside = after
    return found


def _batches(rows: Iterable[tuple[int, list[str]]], width: int) -> Iterator[pa.RecordBatch]:
    """Numbered records as rows of `width` fields; what is missing is null, what is beyond is counted."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, BATCH)):
        columns = list(itertools.zip_longest(*(r for _, r in some)))[:width]
        columns += [(None,) * len(some)] * (width - len(columns))
        arrays = [pa.array(c, pa.string()) for c in columns]
        extra = pa.array([len(r) - width if len(r) > width else None for _, r in some], pa.int32())
        yield pa.RecordBatch.from_arrays([*arrays, extra, pa.array([n - 1 for n, _ in some], pa.int64())], [*[f"c{i}" for i in range(width)], EXTRA, ORDINAL])


def _records(where, delimiter: str, encoding: str, width: int):
    """Lines to the records that begin and end in one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        yield from _batches((r for key, lines in _by_range(batches, encoding) for r in whole(_place(where.value, key), lines)), width)

    def whole(place: Place, lines: Iterator[str]) -> Iterator[tuple[int, list[str]]]:
        if place.inside:
            quotes = Quotes(delimiter)
            next((line for line in lines if not quotes.open_after(line, True)), None)
        number, held = place.first, None
        for row in csv.reader(lines, delimiter=delimiter):
            if row:
                if held:
                    yield held
                held, number = (number, row), number + 1
        if held and not place.open:
            yield held

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            keep = pc.greater_equal(batch.column(ORDINAL), 0)  # not the header
            yield batch if pc.all(keep).as_py() else batch.filter(keep)

    return records


def _place(where: dict[Key, Place], key: Key) -> Place:
    if key not in where:
        raise RuntimeError("the file is split otherwise than when it was scanned (other settings or cores): scan it again")
    return where[key]


def _pieces(where, delimiter: str, encoding: str):
    """Lines to the pieces of records that go on beyond a range: (record, start of the range, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(delimiter)
        for key, lines in _by_range(batches, encoding):
            place, head = _place(where.value, key), []
            if place.inside:
                for line in lines:
                    head.append(line)
                    if not quotes.open_after(line, True):
                        break
                yield _piece(place.before, key, head)
            if place.open:
                number, inside, tail = place.first - 1, False, []
                for line in lines:
                    if not inside and line[0] not in "\r\n":
                        number, tail = number + 1, []
                    tail.append(line)
                    inside = quotes.open_after(line, inside)
                yield _piece(number, key, tail)

    def _piece(number: int, key: Key, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"record": [number], "start": [key[0]], "text": ["".join(lines)]})

    return run


def _joined(delimiter: str, width: int, unended: int | None):
    """Whole records as text to rows. `unended`: the record that the file ends in without a line feed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            rows = []
            for n, text in zip(batch.column("record").to_pylist(), batch.column("text").to_pylist()):
                text = text.removesuffix("\n") if n == unended else text
                if n > 0:
                    rows.append((n, next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))))
            yield from _batches(rows, width)

    return run


def _from_content(delimiter: str, encoding: str, width: int):
    """Whole files to rows, for encodings whose line feeds can't be told byte by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for content in batch.column("content"):
                lines = _lines([content.as_py()], encoding)
                rows = (r for r in csv.reader(lines, delimiter=delimiter) if r)
                yield from _batches(itertools.islice(enumerate(rows), 1, None), width)

    return run


def scan(spark: SparkSession, path: str | Path, delimiter: str | None = None, encoding: str = "utf-8-sig") -> Table:
    """A file's rows as texts (missing fields are null), with ORDINAL from 0 in file order and the number of EXTRA fields, if any.

    Rows are those of Python's csv module, quoted line breaks included. Any path that Spark reads; a folder must hold one
    file. As many tasks read it as Spark splits it into (spark.sql.files.maxPartitionBytes); one task reads a compressed
    file, and one of an encoding like UTF-16, which must be under 2 GB. A record must fit a task's memory. The ranges
    are looked at once, here; should Spark split the file otherwise later, a read fails and says so.
    """
    delimiter = delimiter or sniff(path, encoding, spark)
    names = header(path, delimiter, encoding, spark)
    schema = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(len(names))], T.StructField(EXTRA, T.IntegerType()), T.StructField(ORDINAL, T.LongType())])
    if not _BYTEWISE.match(encoding):
        content = spark.read.format("binaryFile").load(str(path)).select("content")
        return Table(content.mapInArrow(_from_content(delimiter, encoding, len(names)), schema), names, delimiter)
    text = spark.read.option("lineSep", "\n").text(str(path))
    lines = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"))
    kinds = "start long, length long, open0 boolean, open1 boolean, begun0 long, begun1 long, closed boolean"
    states = [States(*r) for r in lines.mapInArrow(_states(delimiter, encoding), kinds).collect()]  # one row a range
    place = places(states)
    where = spark.sparkContext.broadcast(place)
    rows = lines.mapInArrow(_records(where, delimiter, encoding, len(names)), schema)
    beyond = [k[0] for k, p in place.items() if p.inside or p.open]
    if beyond:
        last = place[max(place)]
        at_end = max(states).open1 if last.inside else max(states).open0
        open_record = _open_record(states) if at_end and files.tail(spark, path, 1) != b"\n" else None
        parts = lines if len(beyond) > 1000 else lines.where(F.col("start").isin(beyond))
        pieces = parts.mapInArrow(_pieces(where, delimiter, encoding), "record long, start long, text string")
        whole = pieces.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
        whole = whole.select("record", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
        rows = rows.unionByName(whole.mapInArrow(_joined(delimiter, len(names), open_record), schema))
    return Table(rows, names, delimiter)


def _open_record(states: list[States]) -> int:
    """The number of the last record of a file."""
    inside, n = False, 0
    for r in sorted(states):
        n += r.begun1 if inside else r.begun0
        inside = r.open1 if inside else r.open0
    return n - 1


def malformed(table: Table) -> int:
    """Rows with more fields than the header."""
    return table.rows.where(F.col(EXTRA).isNotNull()).count()

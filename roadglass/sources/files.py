"""Files at any path that Spark reads: their first bytes, their size and digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as arrow_files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20


def _located(spark: SparkSession, path: str | Path):
    """The file system of a path, and the path there; a folder stands for its only visible file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(str(path))
    if fs.getFileStatus(at).isDirectory():
        own = [f.getPath() for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
        if len(own) != 1:
            raise FileNotFoundError(f"{path} is no file, nor a folder of one file")
        at = own[0]
    return fs, at


def pieces(spark: SparkSession, path: str | Path, piece: int = PIECE) -> Iterator[bytes]:
    """The bytes of a file, piece by piece, on the driver."""
    fs, at = _located(spark, path)
    stream = fs.open(at)
    try:
        while data := bytes(stream.readNBytes(piece)):
            yield data
    finally:
        stream.close()


def exists(spark: SparkSession, path: str | Path) -> bool:
    """Whether there is a file at a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def head(spark: SparkSession, path: str | Path, n: int) -> bytes:
    """The first n bytes of a file, or all of a shorter one."""
    return next(pieces(spark, path, n), b"")


def tail(spark: SparkSession, path: str | Path, n: int) -> bytes:
    """The last n bytes of a file, or all of a shorter one."""
    fs, at = _located(spark, path)
    stream = fs.open(at)
    try:
        stream.seek(max(0, fs.getFileStatus(at).getLen() - n))
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str | Path) -> None:
    """Removes a file or folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def digest(path: str | Path) -> str:
    """SHA-256 of a local file, read in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def content_digests(df: DataFrame, content: str) -> DataFrame:
    """df without its column `content`, but with its size_bytes and sha256."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != content]
    return df.select(*rest, F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content, 256).alias("sha256"))


def opened(path: str | Path):
    """A file that driver or executor opens themselves, from any place in it: a local path or one of the stores in STREAMED."""
    scheme, _, rest = str(path).partition(":")
    if scheme not in STREAMED:
        return open(path, "rb")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    fs, at = arrow_files.FileSystem.from_uri(quote(str(path).replace("s3a:", "s3:", 1), safe=":/"))
    return fs.open_input_file(at)


def created(path: str | Path):
    """A file that driver or executor writes themselves, at the places that `opened` knows; local folders must be there."""
    scheme, _, rest = str(path).partition(":")
    if scheme not in STREAMED:
        return open(path, "wb")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "wb")
    fs, at = arrow_files.FileSystem.from_uri(quote(str(path).replace("s3a:", "s3:", 1), safe=":/"))
    return fs.open_output_stream(at)


def listed(path: str | Path, end: str) -> list[str]:
    """The visible files of a folder whose names have that end, by name, at the places that `opened` knows; a file stands for itself."""
    scheme, _, rest = str(path).partition(":")
    if scheme not in STREAMED or scheme == "file":
        fs, at = arrow_files.LocalFileSystem(), str(path) if scheme not in STREAMED else "/" + rest.lstrip("/")
    else:
        fs, at = arrow_files.FileSystem.from_uri(quote(str(path).replace("s3a:", "s3:", 1), safe=":/"))
    if fs.get_file_info(at).type != arrow_files.FileType.Directory:
        return [str(path)]
    own = [f.base_name for f in fs.get_file_info(arrow_files.FileSelector(at)) if f.is_file and f.base_name.endswith(end) and not f.base_name.startswith(("_", "."))]
    if not own:
        raise FileNotFoundError(f"{path} has no {end} files")
    return [f"{str(path).rstrip('/')}/{n}" for n in sorted(own)]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths to the sizes and digests of their files, read piece by piece."""
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            h, n = hashlib.sha256(), 0
            with opened(path) as f:
                while data := f.read(PIECE):
                    h.update(data)
                    n += len(data)
            rows.append((path, n, h.hexdigest()))
        yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("path", "size_bytes", "sha256"))}, _DIGESTS)


_DIGESTS = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string())])
#: Stores that executors open themselves; at others Spark reads whole files, of under 2 GB.
STREAMED = ("file", "s3", "s3a", "gs", "hdfs")


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, size_bytes, sha256 of every file under a path, on the executors.

    Only the listing is Spark's; a task streams its files through the hash, whatever their size. At a store that only
    Spark's readers open, a file must be under 2 GB.
    """
    listed = spark.read.format("binaryFile").load(path)
    first = path if isinstance(path, str) else path[0]
    at = spark._jvm.org.apache.hadoop.fs.Path(first)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() in STREAMED:
        return listed.select("path").mapInArrow(_hashed, "path string, size_bytes long, sha256 string")
    return content_digests(listed.select("path", "content"), "content")


def size_and_digest(spark: SparkSession, path: str | Path) -> tuple[int, str]:
    """Bytes and SHA-256 of a file of any size, by one task."""
    _, at = _located(spark, path)
    r = file_digests(spark, at.toString()).first()
    return r["size_bytes"], r["sha256"]

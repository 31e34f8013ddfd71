"""Shared folders, written tables and distributed connected components."""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable, Collection, Iterator
from contextlib import ExitStack, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one process.
LOCAL_SHARED = "/tmp/checkpoints/roadglass"
#: Rows and bytes of an Arrow batch; whole texts in a batch are what a Python worker's memory goes by.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"
_TUNED = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
#: What was written outside of any `settled` call: path to table name.
_WRITTEN: dict[str, str | None] = {}
#: The registry of the innermost `settled` call of this thread; each call has one of its own.
_REGISTRY: ContextVar[dict[str, str | None]] = ContextVar("roadglass_written", default=_WRITTEN)
#: Settings in force: the value before the first of them, and those that are held now, the newest last.
_HELD: dict[tuple[int, str], tuple[str, list[tuple[object, str]]]] = {}
_HOLD = threading.Lock()


def folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; what a driver that died has left there goes by its id."""
    return f"{shared_dir(spark).rstrip('/')}/roadglass-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_SHARED


#: Removes the shuffle files of a query that is done; what `written` and `bucketed` make is read from the shared folder.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _session(spark: SparkSession) -> int:
    """Tells sessions apart; several Python objects may stand for one."""
    return spark._jsparkSession.hashCode()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what runs inside.

    Callers in several threads share the session: the newest setting holds, and the last one out restores what was before the first.
    """
    mine, own = object(), (_session(spark), key)
    with _HOLD:
        before, held = _HELD.setdefault(own, (spark.conf.get(key), []))
        held.append((mine, value))
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _HOLD:
            held[:] = [x for x in held if x[0] is not mine]
            spark.conf.set(key, held[-1][1] if held else before)
            if not held:
                del _HELD[own]


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches of texts, for as long as the session lasts; inside `settled` they are bounded already."""
    with _HOLD:
        for key, value in _TUNED.items():
            if (_session(spark), key) not in _HELD:
                spark.conf.set(key, value)


def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of n rows for what runs inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder and reads it again; cuts the lineage there. Gives the path too."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _REGISTRY.get()[path] = None
    with setting(spark, _CLEAN_UP, "true"):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed_at(df: DataFrame, name: str, buckets: int, column: str, codec: str = "zstd", apart: str | None = None) -> tuple[DataFrame, str]:
    """Like written, as a table bucketed by a column, which later groups by it needn't shuffle; each value of `apart` in a folder of its own."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{name}"
    _REGISTRY.get()[path] = name
    with setting(spark, _CLEAN_UP, "true"):
        writer = df.write.format("parquet").option("compression", codec).option("path", path).bucketBy(buckets, column)
        (writer.partitionBy(apart) if apart else writer).saveAsTable(name)
    return spark.table(name), path


def bucketed(df: DataFrame, name: str, buckets: int, column: str, codec: str = "zstd") -> DataFrame:
    """`bucketed_at` without the path."""
    return bucketed_at(df, name, buckets, column, codec)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if name := _REGISTRY.get().pop(path, None):
        spark.sql(f"drop table if exists {name}")


def sweep(spark: SparkSession, but: Collection[str] = ()) -> None:
    """Removes every table that this call, or this process outside of such calls, has written, except some; results that still read them must be saved before."""
    for path in [p for p in _REGISTRY.get() if p not in but]:
        drop(spark, path)


def settled(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of a session whose result is written to the shared folder before it returns.

    The tables that were written on the way are removed, and the session's settings are what they were. Each call
    knows its own tables only, so calls in several threads of a session leave each other's alone.
    """

    @functools.wraps(make)
    def run(spark: SparkSession, *args, **more) -> DataFrame:
        mine: dict[str, str | None] = {}
        outer = _REGISTRY.set(mine)
        try:
            with ExitStack() as stack:
                for key, value in _TUNED.items():
                    stack.enter_context(setting(spark, key, value))
                out, path = written(make(spark, *args, **more), make.__name__)
            sweep(spark, {path})
        finally:
            _REGISTRY.reset(outer)
            _REGISTRY.get().update(mine)
        return out

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an undirected edge list: (node, root), one row per node that has an edge.

    Contraction in rounds: each node moves to the neighbour (itself included) of least hash, the edges
    follow and loops and repeats go; about half of the nodes go in each round. The mappings are composed on
    the way back. A hub costs no more than its edges: minima are aggregated before the shuffle, and joins
    on a hub are plain equi-joins, which Spark can split. Each round is a written table.
    Null ends and loops are ignored; nodes of any type that hashes and compares.
    """
    spark = edges.sparkSession
    live = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    live, path = written(live.distinct(), "edges")
    maps: list[DataFrame] = []
    level = 0
    while not live.isEmpty():
        level += 1
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(level), F.col(c)).alias("h"), F.col(c).alias("id"))
        step = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        step = step.select("u", F.least(F.col("m"), rank("u"))["id"].alias("to"))
        step, _ = written(step, "step")
        maps.append(step)
        moved = (
            live.join(step.withColumnRenamed("to", "mu"), "u")
            .join(step.select(F.col("u").alias("v"), F.col("to").alias("mv")), "v")
            .where("mu <> mv")
            .select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v"))
            .distinct()
        )
        old = path
        live, path = written(moved, "edges")
        drop(spark, old)
    if not maps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    root = maps[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        up = root.select(F.col("node").alias("to"), F.col("root"))
        root = step.join(up, "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root"))
    return root

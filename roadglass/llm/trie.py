"""The prefix trie of conversations, by preorder intervals.

Each conversation is a sequence of turns; a node is a distinct prefix, told apart by its depth and 128 bits: the two
64-bit xors of hashes of (depth, SHA-256 of the turn), which are running values along a conversation. Running values
are distributed: rows are dealt into ranges of (conversation, place), each range runs on its own, and one row a range
tells what its first conversation brings in from the ranges before. So no conversation needs to fit one task.

Nodes with the same members form a chain. Its key is (smallest member, members), and the keys of the chains from the
root down to it are its path; paths in lexicographic order are the trie in preorder. A running sum over that order
gives every chain its position; a subtree is an interval, whose end is the greatest position among the chains that
have the chain on their path. Leaves and savings of a subtree are differences of running sums at the interval's ends;
a node inside a chain lacks the savings of the nodes above it there. All paths together hold at most twice as many
keys as there are turns, and a single one at most the square root of that: each key stands for a branch or an end, so
a path of k keys needs conversations of 1, 2, ... k turns.

Turns are ordered by turn (null first), ties by the SHA-256 of role and text; rows that repeat are turns of their own.
Null role or text is empty. Rows without conv_id are left out. Texts of any length only enter as a hash and a count of
code points. A conversation without turns ends at the root. An empty table gives no rows. Other columns are not looked at.

The hash of a node's own conversation ids is one SHA-256 over all of them, which can't be shared among tasks: ids are
packed into chunks of CHUNK_IDS in the order of a range sort, and one task streams a node's chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import written

CHUNK_IDS = 8192
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ["h1", "h2", "d"]


def _scan(group: str, ops: dict[str, str]):
    """Adds run_<column> of each column, by "sum" or "xor" from the first row of a group in this partition, and the row's place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, held, seq = None, dict.fromkeys(ops, 0), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.column(group).to_numpy()
            new = np.append(tail is None or own[0] != tail, own[1:] != own[:-1])
            starts, part = np.flatnonzero(new), np.cumsum(new)
            out = batch
            for name, op in ops.items():
                x = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.concatenate([[0], np.cumsum(x) if op == "sum" else np.bitwise_xor.accumulate(x)])
                base = np.append(-held[name] if op == "sum" else held[name], total[starts])
                run = total[1:] - base[part] if op == "sum" else total[1:] ^ base[part]
                held[name] = int(run[-1])
                out = out.append_column(f"run_{name}", pa.array(run))
            yield out.append_column("seq", pa.array(np.arange(seq, seq + n)))
            tail, seq = own[-1], seq + n

    return scan


def running(df: DataFrame, group: str, order: list[Column | str], ops: dict[str, str], name: str) -> DataFrame:
    """df with run_<column>: running values, this row included, within each group, in an order that starts with the group.

    `group` and the columns are longs without nulls. Only one row a range partition goes through the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = StructType([*ranged.schema, *[StructField(c, LongType()) for c in (*[f"run_{x}" for x in ops], "seq")]])
    ranged, _ = written(ranged.mapInArrow(_scan(group, ops), schema), name)
    ends = ranged.groupBy("part").agg(F.min(F.struct("seq", group))[group].alias("first"), F.max(F.struct("seq", group, *[f"run_{x}" for x in ops])).alias("last"))
    carry, tail, held = [], None, {}
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        mine = held if r["first"] == tail else dict.fromkeys(ops, 0)
        carry.append((r["part"], r["first"], *[mine[x] for x in ops]))
        goes_on = r["last"][group] == r["first"]
        tail = r["last"][group]
        held = {x: _joined(op, r["last"][f"run_{x}"], mine[x] if goes_on else 0) for x, op in ops.items()}
    carried = spark.createDataFrame(carry, f"part int, {group} long, " + ", ".join(f"in_{x} long" for x in ops))
    out = ranged.join(F.broadcast(carried), ["part", group], "left")  # one row a partition
    total = {x: F.coalesce(F.col(f"in_{x}"), F.lit(0)) for x in ops}
    runs = [(F.col(f"run_{x}") + total[x] if op == "sum" else F.col(f"run_{x}").bitwiseXOR(total[x])).alias(f"run_{x}") for x, op in ops.items()]
    return out.select(*df.columns, *runs)


def _joined(op: str, a: int, b: int) -> int:
    return a + b if op == "sum" else a ^ b


def turns(df: DataFrame) -> DataFrame:
    """c, key, size (code points of the text), pos (from 0) of every turn of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", key.alias("key"), F.char_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("one")
    )
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # deals rows that repeat apart
    placed = running(rows, "c", ["c", F.asc_nulls_first("turn"), "key", "salt"], {"one": "sum"}, "turns")
    return placed.select("c", "key", "size", (F.col("run_one") - 1).alias("pos"))


def rebuilt(own: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """c, d (depth, from 0), key, size, last: every conversation with the first turns of the one it goes back to.

    Conversation c takes the first h turns of c - c % span, then its own after its first h; h = crc32(c) % most.
    The remainder has the sign of c, as in SQL.
    """
    counts, _ = written(own.groupBy("c").agg(F.count("*").alias("m")), "counts")
    p = F.col("c") - F.col("c") % span
    convs = counts.select("c", "m", p.alias("p"), F.when(p != F.col("c"), F.crc32(F.col("c").cast("string")) % most).otherwise(0).alias("h"))
    first = counts.select(F.col("c").alias("p"), F.col("m").alias("mp"))
    convs = convs.join(first, "p", "left").withColumn("from_p", F.least("h", F.coalesce("mp", F.lit(0))))
    convs = convs.withColumn("length", F.col("from_p") + F.greatest(F.col("m") - F.col("h"), F.lit(0))).drop("m", "mp")
    convs, _ = written(convs, "convs")
    kept = own.join(convs, "c").where("pos >= h").withColumn("d", F.expr("pos - h + from_p + 1"))
    heads = own.where(F.col("pos") < most).select(F.col("c").alias("p"), "key", "size", "pos")
    taken = convs.where("from_p > 0").join(heads, "p").where("pos < from_p").withColumn("d", F.col("pos") + 1)
    roots = convs.withColumns({"d": F.lit(0).cast("long"), "key": F.lit(None).cast("binary"), "size": F.lit(0).cast("long")})
    columns = ["c", F.col("d").cast("long").alias("d"), "key", "size", (F.col("d") == F.col("length")).alias("last")]
    return kept.select(*columns).unionByName(taken.select(*columns)).unionByName(roots.select(*columns))


def _ids_of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (node, c) in order to chunks of a node's ids as text."""
    held: tuple | None = None
    ids: list[int] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"h1": [held[0]], "h2": [held[1]], "d": [held[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for *node, c in zip(*(batch.column(x).to_pylist() for x in (*_NODE, "c"))):
            if tuple(node) != held or len(ids) == CHUNK_IDS:
                if ids:
                    yield out()
                held, ids = tuple(node), []
            ids.append(c)
    if ids:
        yield out()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of (node, first id) to the SHA-256 of each node's ids."""
    held, sha = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"h1": [held[0]], "h2": [held[1]], "d": [held[2]], "ends_sha256": [sha.hexdigest()]})

    for batch in batches:
        for *node, ids in zip(*(batch.column(x).to_pylist() for x in (*_NODE, "ids"))):
            if tuple(node) == held:
                sha.update(b"," + ids.encode())
                continue
            if sha:
                yield out()
            held, sha = tuple(node), hashlib.sha256(ids.encode())
    if sha:
        yield out()


def _ends(ended: DataFrame) -> DataFrame:
    """h1, h2, d, ends_sha256 of the nodes at which conversations end."""
    n = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = ended.repartitionByRange(n, *_NODE, "c").sortWithinPartitions(*_NODE, "c")
    packed = packed.mapInArrow(_ids_of_nodes, "h1 long, h2 long, d long, first long, ids string")
    whole = packed.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "first")
    return written(whole.mapInArrow(_hashes, "h1 long, h2 long, d long, ends_sha256 string"), "ends")[0]


def _paths(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """c0, n, path: of every chain, the keys (c0, n) of the chains from the root down to it."""
    firsts = chains.select(F.col("c0").alias("c")).distinct()
    heads = chains.select(F.col("head.d").alias("d"), F.col("head.h1").alias("h1"), F.col("head.h2").alias("h2"), "c0", "n")
    on_path = rows.select("c", *_NODE).join(firsts, "c", "left_semi").join(heads, _NODE)
    paths = on_path.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "c0", "n"))).alias("path"))
    mine = F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: F.element_at("path", i)["c0"] == F.col("c"))
    own = paths.select("path", F.explode(mine).alias("i")).select(F.slice("path", F.lit(1), F.col("i")).alias("path"))
    own = own.select(F.transform("path", lambda x: F.struct(x["c0"].alias("c0"), x["n"].alias("n"))).alias("path"))
    return own.select(F.element_at("path", -1)["c0"].alias("c0"), F.element_at("path", -1)["n"].alias("n"), "path")


def trie(sequences: DataFrame) -> DataFrame:
    """Every node of the trie of c, d, key, size, last (as `rebuilt` gives them).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, then the node's preorder
    position (from 1) and the position of the last node of its subtree.
    """
    hashed = sequences.select(
        "c",
        "d",
        "size",
        "last",
        F.when(F.col("key").isNull(), 0).otherwise(F.xxhash64("d", "key")).alias("z1"),
        F.when(F.col("key").isNull(), 0).otherwise(F.xxhash64("key", "d", F.lit(1))).alias("z2"),
    )
    rows = running(hashed, "c", ["c", "d"], {"z1": "xor", "z2": "xor", "size": "sum"}, "prefixes")
    rows = rows.select("c", "d", F.col("run_z1").alias("h1"), F.col("run_z2").alias("h2"), "size", (F.col("run_size") - F.col("size")).alias("above"), "last")
    nodes = rows.groupBy(*_NODE).agg(F.min("c").alias("c0"), F.count("*").alias("n"), F.max("size").alias("size"), F.max("above").alias("above"))
    nodes, _ = written(nodes, "nodes")
    chains = nodes.groupBy("c0", "n").agg(
        F.min(F.struct("d", "h1", "h2")).alias("head"), F.max("d").alias("bottom"), F.min("above").alias("above"), F.max(F.col("above") + F.col("size")).alias("below")
    )
    chains, _ = written(chains, "chains")
    paths, _ = written(_paths(rows, chains), "paths")
    parent = F.get("path", F.size("path") - 2)
    children = paths.where(F.size("path") > 1).select(parent["c0"].alias("c0"), parent["n"].alias("n")).groupBy("c0", "n").agg(F.count("*").alias("children"))
    facts = paths.join(chains, ["c0", "n"]).join(children, ["c0", "n"], "left").select(
        "path",
        "c0",
        "n",
        F.col("head.d").alias("top"),
        "bottom",
        F.col("above").alias("top_above"),
        F.coalesce("children", F.lit(0)).cast("long").alias("children"),
        F.col("children").isNull().cast("long").alias("leaf"),
        ((F.col("n") - 1) * (F.col("below") - F.col("above"))).alias("saved"),
        (F.col("bottom") - F.col("head.d") + 1).alias("length"),
        F.lit(0).cast("long").alias("all"),
    )
    ranked = running(facts, "all", ["path"], {"leaf": "sum", "saved": "sum", "length": "sum"}, "ranked")
    end = F.struct(F.col("run_length").alias("position"), F.col("run_leaf").alias("leaves"), F.col("run_saved").alias("saved"))
    intervals = ranked.select(F.explode("path").alias("over"), end.alias("end")).groupBy(F.col("over.c0").alias("c0"), F.col("over.n").alias("n")).agg(F.max("end").alias("end"))
    placed = ranked.join(intervals, ["c0", "n"]).select(
        "c0",
        "n",
        "top",
        "bottom",
        "top_above",
        "children",
        parent["c0"].alias("parent"),
        (F.col("end.leaves") - F.col("run_leaf") + F.col("leaf")).alias("leaves"),
        (F.col("end.saved") - F.col("run_saved") + F.col("saved")).alias("saved"),
        (F.col("run_length") - F.col("length") + 1).alias("position"),
        F.col("end.position").alias("end"),
    )
    placed, _ = written(placed, "placed")
    ends = _ends(rows.where("last").select(*_NODE, "c"))
    below = F.col("d") > F.col("top")
    return nodes.join(placed, ["c0", "n"]).join(ends, _NODE, "left").select(
        F.col("c0").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(below, F.col("c0")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("d") < F.col("bottom"), 1).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("above") - F.col("top_above"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        (F.col("position") + F.col("d") - F.col("top")).alias("position"),
        F.col("end").alias("subtree_end"),
    )


def conversation_trie(df: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations of conv_id, turn, role, text."""
    return trie(rebuilt(turns(df), span, most))

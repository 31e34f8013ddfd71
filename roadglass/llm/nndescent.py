"""Near-duplicate vectors by NN-descent.

Equal vectors are one class with a count. Every class keeps a list of its best neighbours. The lists start from TREES
random-projection orders: classes in the order of the signs of random projections, LEAF at a time, compared within.
Then rounds follow: each class brings its neighbours and those that list it together, in groups of about GROUP, and
those pairs of which one is new on the list are compared; what is better than a list's last entry goes onto it. Hubs,
which many list, are dealt into several groups, anew each round. A list whose entries are all links is saturated: it is
enlarged (twice as long, up to LARGEST) and its neighbours count as new again. The rounds end when they hardly find links
any more. An audit then compares AUDIT classes, chosen by hash, with all others; while its recall is under RECALL,
more orders and rounds follow, MAX_ROUNDS rounds at most. Only similarities of at least `link` are kept as links.

Classes that are saturated at LARGEST are counted exactly: the members of their component are packed into blocks of
BLOCK, pairs of blocks that are too far apart (by centre and radius) are left out, the rest are compared. So no list
length limits a result, no pairs are written for dense groups, and a family of near copies without a bound costs block
products only.

Cosines are in double precision, of vectors scaled by their largest component. Null or empty vectors, those with null or
non-finite components and zero vectors link with nothing: no links, their own component, kept. Vectors of different
lengths don't link. Rows that repeat are vectors of their own and link with each other. A row without id counts as a
vector, but gives no component its id; a component of such rows only has a null id, and its rows are kept. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ._common import arrow_rows, components, written

LINK = 0.95
TREES, LEAF, LIST, LARGEST, GROUP = 6, 128, 8, 32, 48
AUDIT, RECALL, MAX_ROUNDS, FEW = 1024, 0.99, 12, 0.002
BLOCK = 1024
BITS = 62
_PAIRS = "u long, v long, sim double"


def _units(column: pa.Array, a: int, b: int) -> np.ndarray:
    """Rows a to b of a list column, whose lengths are equal, as unit vectors of doubles."""
    offsets = column.offsets.to_numpy()
    x = column.values.to_numpy()[offsets[a] : offsets[b]].astype(np.float64).reshape(b - a, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pairs(u: list, v: list, sim: list) -> pa.RecordBatch:
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.RecordBatch.from_pydict({"u": pa.array(cat(u, np.int64)), "v": pa.array(cat(v, np.int64)), "sim": pa.array(cat(sim, np.float64))})


def _list_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(name)
    return pa.concat_arrays([column]) if column.offset else column  # offsets from 0


def _orders(first: int, trees: int):
    """Classes to rows of each order: its number and the signs of BITS random projections, the first the highest."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            vectors = _list_of(batch, "v")
            keys = np.empty((trees, batch.num_rows), np.int64)
            edges = np.flatnonzero(np.append(True, dims[1:] != dims[:-1])) if len(dims) else []
            for a, b in zip(edges, [*edges[1:], len(dims)]):
                x = _units(vectors, a, b)
                for t in range(trees):
                    at = first + t, int(dims[a])
                    if at not in planes:
                        planes[at] = np.random.default_rng(at).standard_normal((at[1], BITS))
                    keys[t, a:b] = ((x @ planes[at]) > 0) @ (1 << np.arange(BITS - 1, -1, -1))
            for t in range(trees):
                out = batch.append_column("tree", pa.array(np.full(batch.num_rows, first + t, np.int32)))
                yield out.append_column("signs", pa.array(keys[t]))

    return signs


def _signed(rows: DataFrame) -> StructType:
    return StructType([*rows.schema, StructField("tree", IntegerType()), StructField("signs", LongType())])


def _leaves(leaf: int, keep: int):
    """Rows of an order to the `keep` best neighbours of each among `leaf` rows that follow each other."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def runs(table: pa.Table, end: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            table = table.combine_chunks()
            ids = table["cls"].to_numpy()
            kinds = table["tree"].to_numpy().astype(np.int64) + (table["dim"].to_numpy().astype(np.int64) << 32)
            vectors = table["v"].chunk(0) if table.num_rows else None
            out, at = [], 0
            edges = np.append(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, len(kinds))
            while at < len(ids):
                stop = int(edges[np.searchsorted(edges, at, "right")])
                if stop - at < leaf and stop == len(ids) and not end:
                    break
                b = min(at + leaf, stop)
                sim = (x := _units(vectors, at, b)) @ x.T
                np.fill_diagonal(sim, -2)
                n = min(keep, b - at - 1)
                if n:
                    best = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                    who = np.arange(b - at)[:, None]
                    out.append(_pairs([np.repeat(ids[at:b], n)], [ids[at:b][best].ravel()], [sim[who, best].ravel()]))
                at = b
            return out, table.slice(at)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            out, held = runs(pa.concat_tables([held, table]) if held is not None else table, False)
            yield from out
        if held is not None:
            yield from runs(held, True)[0]

    return compare


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of (w, part), in order: members that are new to w against all members, if better than a list's last entry."""

    def compare(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        m, new, last = (table[c].to_numpy() for c in ("m", "new", "last"))
        w, part, vectors = table["w"].to_numpy(), table["part"].to_numpy(), table["v"].chunk(0)
        edges = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (part[1:] != part[:-1])]))
        us, vs, sims = [], [], []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(w)]):
            if b - a < 2 or not new[a:b].any():
                continue
            sim = (x := _units(vectors, a, b)) @ x.T
            ids = m[a:b]
            good = (sim > last[a:b, None]) & (new[a:b, None] | new[None, a:b]) & (ids[:, None] != ids[None])
            i, j = np.nonzero(good)
            us.append(ids[i]), vs.append(ids[j]), sims.append(sim[i, j])
        return _pairs(us, vs, sims)

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        w, part = table["w"].to_numpy(), table["part"].to_numpy()
        own = np.flatnonzero((w != w[-1]) | (part != part[-1]))
        cut = int(own[-1]) + 1 if len(own) else 0
        if cut:
            yield compare(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield compare(held)


def _brute(sample: dict[int, tuple[np.ndarray, np.ndarray]], link: float):
    """Classes to their links with a sample (by length: ids and unit vectors)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, sims = [], [], []
            ids, dims, vectors = batch.column("cls").to_numpy(), batch.column("dim").to_numpy(), _list_of(batch, "v")
            edges = np.flatnonzero(np.append(True, dims[1:] != dims[:-1])) if len(dims) else []
            for a, b in zip(edges, [*edges[1:], len(dims)]):
                if int(dims[a]) in sample:
                    own, x = sample[int(dims[a])]
                    sim = x @ _units(vectors, a, b).T
                    i, j = np.nonzero((sim >= link) & (own[:, None] != ids[None, a:b]))
                    us.append(own[i]), vs.append(ids[a:b][j]), sims.append(sim[i, j])
            yield _pairs(us, vs, sims)

    return compare


def _started(classes: DataFrame, first: int, trees: int) -> DataFrame:
    """u, v, sim of the best neighbours in some more orders."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("cls", "dim", "v")
    signed = rows.mapInArrow(_orders(first, trees), _signed(rows))
    order = ["dim", "tree", "signs", "cls"]
    return signed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_leaves(LEAF, LIST), _PAIRS)


def _listed(entries: DataFrame, caps: DataFrame | None) -> DataFrame:
    """u, v, sim, new, k: the best entries of each list, as many as its length k. An entry that was there before isn't new."""
    one = entries.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    ranked = one.withColumn("place", place).where(F.col("place") <= LARGEST)
    if caps is None:
        return ranked.where(F.col("place") <= LIST).select("u", "v", "sim", "new", F.lit(LIST).alias("k"))
    return ranked.join(caps, "u", "left").withColumn("k", F.coalesce("k", F.lit(LIST))).where("place <= k").select("u", "v", "sim", "new", "k")


def _state(lists: DataFrame, link: float) -> DataFrame:
    """u, k, whether the list is saturated, and what a newcomer must exceed."""
    full = F.count("*") >= F.max("k")
    return lists.groupBy("u").agg(
        F.max("k").alias("k"), (full & (F.min("sim") >= link)).alias("saturated"), F.when(full, F.min("sim")).otherwise(-2.0).alias("last")
    )


def _round(classes: DataFrame, lists: DataFrame, state: DataFrame, number: int) -> DataFrame:
    """u, v, sim of what the classes' neighbours find in each other."""
    spark = classes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grown = state.where(f"saturated and k < {LARGEST}").select("u", F.lit(True).alias("grown"))
    edges = lists.join(grown, "u", "left").select("u", "v", (F.col("new") | F.col("grown").isNotNull()).alias("new"))
    both = edges.select(F.col("u").alias("w"), F.col("v").alias("m"), "new").unionByName(edges.select(F.col("v").alias("w"), F.col("u").alias("m"), "new"))
    both, _ = written(both.groupBy("w", "m").agg(F.max("new").alias("new")), "both")
    sizes, _ = written(both.groupBy("w").agg(F.ceil(F.count("*") / GROUP).alias("parts"), F.max("new").alias("any")).where("any").drop("any"), "sizes")
    members = both.join(sizes, "w").withColumn("part", F.pmod(F.xxhash64("m", F.lit(number)), F.col("parts")))
    last = state.select(F.col("u").alias("m"), F.when(F.col("saturated") & (F.col("k") < LARGEST), -2.0).otherwise(F.col("last")).alias("last"))
    last, _ = written(classes.select(F.col("cls").alias("m"), "v").join(last, "m", "left").withColumn("last", F.coalesce("last", F.lit(-2.0))), "last")
    groups = members.select("w", "part", "m", "new").join(last, "m")
    return groups.repartition(n, "w", "part").sortWithinPartitions("w", "part").mapInArrow(_meet, _PAIRS)


def _recall(classes: DataFrame, lists: DataFrame, state: DataFrame, link: float) -> tuple[int, int]:
    """Of the links of a sample with all classes: how many the lists hold or will be counted exactly, and how many there are."""
    some = classes.orderBy(F.xxhash64(F.lit("audit"), "cls"), "cls").limit(AUDIT).select("cls", "dim", "v").collect()
    sample = {}
    for dim in {r["dim"] for r in some}:
        own = [r for r in some if r["dim"] == dim]
        x = pa.array([list(r["v"]) for r in own])
        sample[dim] = np.array([r["cls"] for r in own], np.int64), _units(x, 0, len(own))
    true = classes.select("cls", "dim", "v").mapInArrow(_brute(sample, link), _PAIRS).select("u", "v")
    held = lists.where(F.col("sim") >= link)
    held = held.select("u", "v").unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().withColumn("held", F.lit(True))
    exact = state.where("saturated").select("u", F.lit(True).alias("exact"))
    true = true.join(held, ["u", "v"], "left").join(exact, "u", "left").join(exact.select(F.col("u").alias("v"), F.col("exact").alias("exact_v")), "v", "left")
    r = true.agg(F.count("*").alias("all"), F.count(F.coalesce("held", "exact", "exact_v")).alias("held")).first()
    return r["held"], r["all"]


def neighbours(classes: DataFrame, link: float = LINK) -> tuple[DataFrame, DataFrame, float]:
    """The lists (u, v, sim), their state (u, saturated) after the last round, and the audited recall."""
    lists, _ = written(_listed(_started(classes, 0, TREES).withColumn("new", F.lit(True)), None), "lists")
    trees, recall = TREES, 0.0
    for number in range(1, MAX_ROUNDS + 1):
        state, _ = written(_state(lists, link), "state")
        caps = state.select("u", F.when(F.col("saturated"), F.least(2 * F.col("k"), F.lit(LARGEST))).otherwise(F.col("k")).alias("k"))
        entries = lists.select("u", "v", "sim", F.lit(False).alias("new"))
        lists, _ = written(_listed(entries.unionByName(_round(classes, lists, state, number).withColumn("new", F.lit(True))), caps), "lists")
        r = lists.where(F.col("sim") >= link).agg(F.count("*").alias("links"), F.count(F.when(F.col("new"), 1)).alias("new")).first()
        if r["new"] > FEW * r["links"] and number < MAX_ROUNDS:
            continue
        state, _ = written(_state(lists, link), "state")
        held, true = _recall(classes, lists, state, link)
        recall = held / true if true else 1.0
        if recall >= RECALL:
            break
        more = _started(classes, trees, TREES).withColumn("new", F.lit(True))
        caps = state.select("u", "k")
        lists, _ = written(_listed(lists.select("u", "v", "sim", "new").unionByName(more), caps), "lists")
        trees += TREES
    return lists, _state(lists, link), recall


def _blocks(rows: int):
    """Members of components in order to blocks: ids, counts, which are saturated, unit vectors, centre and radius."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            x = _units(table["v"].chunk(0), 0, table.num_rows)
            centre = x.mean(0)
            centre = centre / max(float(np.sqrt(centre @ centre)), 1e-300)
            radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
            sat = table["saturated"].to_numpy()
            ids, n = table["cls"].to_numpy(), table["n"].to_numpy()
            return pa.RecordBatch.from_pydict(
                {"root": [table["root"][0].as_py()], "ids": [ids.tobytes()], "n": [n.tobytes()], "sat": [sat.tobytes()], "any": [bool(sat.any())], "x": [x.tobytes()], "centre": [centre.tolist()], "radius": [radius]}
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            while held.num_rows:
                roots = held["root"].to_numpy()
                own = int(np.searchsorted(roots != roots[0], True))
                if own == held.num_rows and own < rows:
                    break
                yield out(held.slice(0, min(own, rows)))
                held = held.slice(min(own, rows))
        if held is not None and held.num_rows:
            yield out(held)

    return pack


def _count(link: float):
    """Pairs of blocks to what the first one's saturated classes link with in the second: weights, and links with others' lists."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, other = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["oids"], np.int64)
                sat, osat = np.frombuffer(r["sat"], bool), np.frombuffer(r["osat"], bool)
                x, y = np.frombuffer(r["x"]).reshape(len(ids), -1), np.frombuffer(r["ox"]).reshape(len(other), -1)
                own = np.flatnonzero(sat)
                linked = (x[own] @ y.T >= link) & (ids[own, None] != other[None])
                weights = linked @ np.frombuffer(r["on"], np.int64)
                i, j = np.nonzero(linked & ~osat[None])
                yield pa.RecordBatch.from_pydict(
                    {"u": pa.array(np.concatenate([ids[own], ids[own][i]])), "v": pa.array([None] * len(own) + other[j].tolist(), pa.int64()), "weight": pa.array(np.concatenate([weights, np.zeros(len(i), np.int64)]))}
                )

    return count


def _completed(classes: DataFrame, roots: DataFrame, state: DataFrame, link: float) -> DataFrame:
    """u, v, weight: for saturated u the number of rows it links with, in parts (v is null), and its links v with unsaturated ones."""
    spark = classes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    saturated = state.where("saturated").select(F.col("u").alias("cls"))
    dense = roots.join(saturated.withColumnRenamed("cls", "node"), "node", "left_semi").select("root").distinct()
    members = roots.join(dense, "root", "left_semi").select(F.col("node").alias("cls"), "root").join(classes.select("cls", "dim", "n", "v"), "cls")
    members = members.join(saturated.withColumn("sat", F.lit(True)), "cls", "left").withColumn("saturated", F.col("sat").isNotNull()).drop("sat")
    rows = members.select("cls", "dim", "v", "n", "root", "saturated")
    signed = rows.mapInArrow(_orders(0, 1), _signed(rows))
    order = ["root", "signs", "cls"]
    packed = signed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _blocks(BLOCK), "root long, ids binary, n binary, sat binary, any boolean, x binary, centre array<double>, radius double"
    )
    packed, _ = written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    a = packed.where("any").select("root", F.col("block").alias("a"), "centre", "radius")
    b = packed.select("root", F.col("block").alias("b"), F.col("centre").alias("centre_b"), F.col("radius").alias("radius_b"))
    dot = F.aggregate(F.zip_with("centre", "centre_b", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    near = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))) <= F.col("radius") + F.col("radius_b") + float(np.arccos(link)) + 1e-6
    pairs, _ = written(a.join(b, "root").where(near).select("a", "b"), "block_pairs")
    first = packed.select(F.col("block").alias("a"), "ids", "sat", "x")
    second = packed.select(F.col("block").alias("b"), F.col("ids").alias("oids"), F.col("sat").alias("osat"), F.col("n").alias("on"), F.col("x").alias("ox"))
    with arrow_rows(spark, 4):  # rows are pairs of blocks
        return written(pairs.repartition("a", "b").join(first, "a").join(second, "b").mapInArrow(_count(link), "u long, v long, weight long"), "counted")[0]


def near_links(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", link: float = LINK) -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    spark = df.sparkSession
    kind = df.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if kind in ("float", "double") else F.col(vector).cast("array<double>")
    finite = F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.when(usable, F.transform(v, lambda x: x + 0)).alias("v"))  # no negative zeros
    keys = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2")]
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    classes = classes.select(F.monotonically_increasing_id().alias("cls"), F.size("v").alias("dim"), "n", "first", "v")
    classes, _ = written(classes, "classes")
    with arrow_rows(spark, 4000):
        lists, state, _ = neighbours(classes, link)
        state, _ = written(state, "state")
        held = lists.where(F.col("sim") >= link)
        pairs, _ = written(held.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
        roots, _ = written(components(pairs), "roots")
        counted = _completed(classes, roots, state, link)
    exact = counted.where("v is null").groupBy("u").agg(F.sum("weight").alias("exact"))
    ends = pairs.unionByName(counted.where("v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()
    ends = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(classes.select(F.col("cls").alias("v"), "n"), "v")
    ends = ends.groupBy("u").agg(F.sum("n").alias("found"))
    # Every link that the exact count finds lies within a component already.
    least = roots.join(classes.select(F.col("cls").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    least, _ = written(least, "least")
    named = roots.join(least, "root").select(F.col("node").alias("cls"), "least")
    facts = classes.join(named, "cls", "left").join(ends.withColumnRenamed("u", "cls"), "cls", "left").join(exact.withColumnRenamed("u", "cls"), "cls", "left")
    facts = facts.select(*keys, (F.col("n") - 1 + F.coalesce("exact", "found", F.lit(0))).alias("n_links"), F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    facts, _ = written(facts, "facts")
    linked = rows.where("v is not null").select("id", *keys).join(facts, ["h", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Centroid clustering by kd-tree filtering, in whole numbers.

Each partition packs its vectors, TREE_ROWS at a time, into kd-trees, written once and read in every round. A node
holds its count, the sums of its components and its box. A round walks every tree from the root with the list of
centroids that may be nearest somewhere in a node's box: the centroid nearest to the box's middle stays, and any
other goes if even in the corner that favours it most it is strictly farther (whole numbers, so a tie never goes).
A node with one centroid left is assigned whole by its count and sums; leaves compare their vectors with what is
left. To the driver go, once a round, the counts and sums of all vectors by centroid and component: at most
centroids x components x LIMBS rows, whatever the input's size.

Vectors that are null, hold null or non-finite components or don't have exactly `dim` components are left out.
Component x becomes floor(scale * x). Numbers of any size stay exact: sums and squared distances that pass 64 bits are
made in Python's whole numbers, and only the columns saturate at the ends of a long. Ties go to the smaller centroid
number; of vectors with equal hashes (repeated ids) those of smaller components start centroids first. Rows with a null
id are assigned like others but start centroids only after all rows with ids. Repeated rows count as often as they
are there. With fewer vectors than k, there are as many centroids as vectors; an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_rows, tune, written

SCALE, DIM, K, ROUNDS = 64, 64, 16, 3
#: Vectors of a tree and of a leaf.
TREE_ROWS, LEAF_ROWS = 16_384, 32
#: Whole numbers up to here in size give exact squared distances in 64 bits and in doubles alike (64 components).
EXACT = 1 << 22
LIMB = 32
_TREE = "ids binary, at binary, x binary, wide boolean, nodes binary, low binary, high binary, sums binary"


def _ints(a: np.ndarray, wide: bool) -> bytes:
    """An array of whole numbers as bytes; those of any size as decimal text."""
    return ",".join(map(str, a.ravel().tolist())).encode() if wide else a.astype(np.int64).tobytes()


def _array(b: bytes, wide: bool, dim: int) -> np.ndarray:
    if wide:
        return np.array([int(t) for t in b.decode().split(",")] if b else [], object).reshape(-1, dim)
    return np.frombuffer(b, np.int64).reshape(-1, dim)


def _whole(v: pd.Series, dim: int) -> np.ndarray:
    """floor(scale * x) of rows of `dim` doubles; int64 where distances are exact in it, else Python's numbers."""
    f = np.array(v.tolist(), np.float64).reshape(len(v), dim)
    with np.errstate(over="ignore"):
        scaled = np.floor(f * SCALE)
    if not np.isfinite(scaled).all():  # beyond doubles: multiply exactly
        return np.frompyfunc(lambda x: int(x) * SCALE if abs(x) > 2**53 else int(np.floor(x * SCALE)), 1, 1)(f)
    return scaled.astype(np.int64) if np.abs(scaled).max(initial=0) <= EXACT else np.frompyfunc(int, 1, 1)(scaled)


def _tree(ids: np.ndarray, known: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    """One kd-tree as a row. Nodes in preorder: first and end place, place of the second child (0: a leaf)."""
    wide = x.dtype == object
    order = np.arange(len(x))
    nodes: list[list[int]] = []
    low, high, sums = [], [], []

    def grow(a: int, b: int) -> None:
        own = x[order[a:b]]
        lo, hi = own.min(0), own.max(0)
        me = len(nodes)
        nodes.append([a, b, 0])
        low.append(lo), high.append(hi), sums.append(own.sum(0))
        spread = hi - lo
        axis = int(spread.argmax())
        if b - a <= LEAF_ROWS or spread[axis] == 0:
            return
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)] if not wide else order[a:b][np.argsort(own[:, axis], kind="stable")]
        grow(a, a + middle)
        nodes[me][2] = len(nodes)
        grow(a + middle, b)

    grow(0, len(x))
    return pd.DataFrame(
        {
            "ids": [ids[order].tobytes()],
            "at": [known[order].tobytes()],
            "x": [_ints(x[order], wide)],
            "wide": [wide],
            "nodes": [np.array(nodes, np.int64).tobytes()],
            "low": [_ints(np.array(low), wide)],
            "high": [_ints(np.array(high), wide)],
            "sums": [_ints(np.array(sums), wide)],
        }
    )


def _plant(dim: int):
    """Rows of (id, whether it is known, vector) to trees of this partition."""

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if len(batch):
                held.append((batch["id"].to_numpy(np.int64), batch["known"].to_numpy(bool), _whole(batch["v"], dim)))
            while sum(len(h[0]) for h in held) >= TREE_ROWS:
                all_ = [np.concatenate(p) for p in zip(*held)]
                yield _tree(*[p[:TREE_ROWS] for p in all_])
                held = [tuple(p[TREE_ROWS:] for p in all_)]
        if sum(len(h[0]) for h in held):
            yield _tree(*[np.concatenate(p) for p in zip(*held)])

    return plant


def _squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1)


def _near(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centroid, exact; numbers no larger than EXACT fit the products' doubles."""
    if x.dtype == object or centroids.dtype == object:
        return np.array([_squares(x - c) for c in centroids], object).T.reshape(len(x), len(centroids))
    cross = x.astype(np.float64) @ centroids.T.astype(np.float64)
    return _squares(x)[:, None] + _squares(centroids)[None] - 2 * cross.astype(np.int64)


def filtered(nodes: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes that cover all vectors once, each with the numbers of the centroids that may be nearest within it."""
    stack = [(0, np.arange(len(centroids)))]
    while stack:
        node, live = stack.pop()
        if len(live) > 1:
            lo, hi, c = low[node], high[node], centroids[live]
            best = c[_squares(2 * c - (lo + hi)).argmin()]
            corner = np.where(c > best, hi, lo)
            live = live[_squares(c - corner) <= _squares(best - corner)]
        if len(live) == 1 or not nodes[node, 2]:
            yield node, live
        else:
            stack += [(int(nodes[node, 2]), live), (node + 1, live)]


def _read(r, centroids: np.ndarray) -> tuple[np.ndarray, ...]:
    """A tree's arrays and the centroids, all in one kind of number that is exact for both."""
    dim = centroids.shape[1]
    nodes = np.frombuffer(r.nodes, np.int64).reshape(-1, 3)
    parts = [_array(b, r.wide, dim) for b in (r.x, r.low, r.high, r.sums)]
    if r.wide or centroids.dtype == object:
        parts, centroids = [p.astype(object) for p in parts], centroids.astype(object)
    return nodes, *parts, centroids


def _limbs(value: int) -> list[int]:
    """Digits to base 2^LIMB, least first; the last one carries the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _gather(centroids: np.ndarray):
    """Trees to the counts and sums of their vectors by centroid: (cluster, component or -1 for the count, limb, value)."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [0] * len(centroids)
        totals = np.zeros(centroids.shape, object)
        for batch in batches:
            for r in batch.itertuples(index=False):
                nodes, x, low, high, sums, cs = _read(r, centroids)
                for node, live in filtered(nodes, low, high, cs):
                    a, b, _ = nodes[node].tolist()
                    if len(live) == 1:
                        counts[live[0]] += b - a
                        totals[live[0]] += sums[node].astype(object)
                        continue
                    own = live[_near(x[a:b], cs[live]).argmin(1)]
                    for k in np.unique(own).tolist():
                        counts[k] += int((own == k).sum())
                        totals[k] += x[a:b][own == k].sum(0).astype(object)
        rows = [(k, d, i, limb) for k, n in enumerate(counts) if n for d, v in enumerate([n, *totals[k].tolist()], -1) for i, limb in enumerate(_limbs(int(v)))]
        yield pd.DataFrame(rows, columns=["cluster", "component", "limb", "value"])

    return gather


def _assign(centroids: np.ndarray):
    """Trees to (id, cluster, distance) of each vector."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                nodes, x, low, high, _, cs = _read(r, centroids)
                cluster, distance = np.empty(len(x), np.int32), np.empty(len(x), x.dtype)
                for node, live in filtered(nodes, low, high, cs):
                    a, b, _ = nodes[node].tolist()
                    d = _near(x[a:b], cs[live])
                    nearest = d.argmin(1)
                    cluster[a:b], distance[a:b] = live[nearest], d[np.arange(b - a), nearest]
                ids = pd.Series(np.frombuffer(r.ids, np.int64)).astype("Int64").where(np.frombuffer(r.at, bool))
                # Distances go on as text where they may pass a long; their sums are made exactly.
                yield pd.DataFrame({"id": ids, "cluster": cluster, "exact": [str(d) for d in distance.tolist()] if x.dtype == object else None, "distance": np.minimum(distance, 2**63 - 1).astype(np.int64)})

    return assign


def _inertia(dim: int):
    """(cluster, exact, distance) to sums by cluster in limbs."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, int] = {}
        for batch in batches:
            for k in batch["cluster"].unique().tolist():
                own = batch[batch["cluster"] == k]
                far = own["exact"].notna()
                some = own.loc[~far, "distance"].to_numpy()
                total = int((some >> 32).sum()) * 2**32 + int((some & (2**32 - 1)).sum()) + sum(map(int, own.loc[far, "exact"]))
                sums[k] = sums.get(k, 0) + total
        rows = [(k, 0, i, v) for k, s in sums.items() for i, v in enumerate(_limbs(s))]
        yield pd.DataFrame(rows, columns=["cluster", "component", "limb", "value"])

    return add


_SUMS = "cluster int, component int, limb int, value long"


def _summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Whole sums by (cluster, component), from the partitions' limbs; a bounded number of rows reaches the driver."""
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect():
        key = r["cluster"], r["component"]
        out[key] = out.get(key, 0) + (r["value"] << LIMB * r["limb"])
    return out


def _packed(centroids: list[list[int]]) -> np.ndarray:
    big = max((abs(x) for c in centroids for x in c), default=0)
    return np.array(centroids, np.int64 if big <= EXACT else object)


def _seeds(rows: DataFrame, k: int, seed: str, dim: int) -> list[list[int]]:
    """The vectors of smallest hashes of seed:id, in the order of the hashes."""
    order = F.sha2(F.concat(F.lit(seed + ":"), F.col("id").cast("string")), 256)
    first = rows.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return [[int(x) for x in _whole(pd.Series([r["v"]]), dim)[0]] for r in first]


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = "1"
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = df.sparkSession
    tune(spark)
    usable = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(vector).isNotNull() & usable).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    centroids = _seeds(rows, k, seed, dim)
    if not centroids:
        return _result(spark, df, id_col, None, [], {})
    known = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "v")
    trees, _ = written(known.mapInPandas(_plant(dim), _TREE), "trees")
    with arrow_rows(spark, 1):  # a row is a tree
        for _ in range(rounds):
            sums = _summed(trees.mapInPandas(_gather(_packed(centroids)), _SUMS))
            centroids = [[sums[i, d] // sums[i, -1] for d in range(dim)] if (i, -1) in sums else c for i, c in enumerate(centroids)]
        assigned, _ = written(trees.mapInPandas(_assign(_packed(centroids)), "id long, cluster int, exact string, distance long"), "assigned")
    sums = _summed(assigned.select("cluster", "exact", "distance").mapInPandas(_inertia(dim), _SUMS))
    return _result(spark, df, id_col, assigned, centroids, {k: s for (k, _), s in sums.items()})


def _result(spark: SparkSession, df: DataFrame, id_col: str, assigned: DataFrame | None, centroids: list[list[int]], inertia: dict[int, int]) -> DataFrame:
    top = 2**63 - 1
    total = min(sum(inertia.values()), top)
    rows = [(k, min(inertia[k], top), total, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k in sorted(inertia)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    if assigned is None:
        assigned = facts.select(F.lit(None).cast("long").alias("id"), "cluster", F.lit(None).cast("long").alias("distance"))
    out = assigned.join(F.broadcast(facts), "cluster")  # one row a centroid
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

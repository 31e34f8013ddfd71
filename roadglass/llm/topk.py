"""Exact top-k by inner product, with pivot-table elimination.

Vectors become whole numbers and are packed in blocks, by their nearest pivot, with a table of their distances
to PIVOTS pivots. For a query and a block, the triangle inequality over all pivots gives each candidate a
greatest lower bound of its distance, which bounds its inner product from above; candidates are evaluated in
the order of that bound until the k-th best score exceeds the next bound. Every query starts from a k-th best
score: that over a bounded sample (SAMPLE vectors, by hash of the id), which no row of the result can be below.
The least and greatest distances of a block to each pivot bound all its candidates at once, so a block that
can't reach a query's score is not looked into. Query blocks meet data blocks by slots, of which there are as
many as data blocks or four for each partition, each with about as many; the blocks' results (k for each query
at most) are merged by rank.

The pivots come from the same sample, farthest first; sample and pivots only steer the order of evaluation,
the result is exact whatever they are.

Null vectors, those with null or non-finite components and null ids take no part. Scores beyond a long are
its ends. A query meets candidates of its own length only. Rows that repeat an id's vector count once; rows of
the query's own id are not its candidates. Ties go to the smaller id. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_rows, tune, written

SCALE = 256
PIVOTS, PIVOT_SAMPLE, SAMPLE = 24, 512, 4096
DATA_ROWS, QUERY_ROWS = 2048, 256
CHUNK = 128


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers of any size."""
    return np.frompyfunc(int, 1, 1)(x)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if x.shape[1] != pivots.shape[1] or not len(pivots):
        return np.zeros((len(x), 0))
    return np.sqrt(np.maximum(_norms(x)[:, None] + _norms(pivots)[None] - 2 * (x @ pivots.T), 0))


def _exact(*parts: np.ndarray) -> bool:
    """Whether sums of products of these numbers are exact in doubles."""
    big = max([float(np.abs(x).max(initial=0)) for x in parts], default=0.0)
    return big**2 * max([x.shape[1] for x in parts], default=1) < 2**53


def _least_scores(x: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample (different ids, not its own); minus infinity where there are fewer."""
    if x.shape[1] != sample.shape[1] or len(sample) < k or not _exact(x, sample):
        return np.full(len(x), -np.inf)
    scores = x @ sample.T
    scores[ids[:, None] == sample_ids[None]] = -np.inf
    return np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]


def _blocks(pivots: np.ndarray, rows: int, least=None):
    """Rows of (id, vector) to blocks of one vector length and (without `least`) one nearest pivot: ids, whole numbers, distances to the pivots, least scores."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def out(cell: tuple) -> pd.DataFrame:
            own = held.pop(cell)
            ids, x, d = (np.concatenate(p) for p in zip(*own))
            kind = np.float64 if np.abs(x).max(initial=0) > 30000 else np.int16
            scores = np.zeros(0) if least is None else least(x, ids)
            return pd.DataFrame({"dim": [x.shape[1]], "n": [len(ids)], "ids": [ids.tobytes()], "x": [x.astype(kind).tobytes()], "d": [d.tobytes()], "least": [scores.tobytes()]})

        for batch in batches:
            sizes = batch["v"].map(len).to_numpy()
            for dim in np.unique(sizes):
                some = np.flatnonzero(sizes == dim)
                x = np.floor(np.array(batch["v"].iloc[some].tolist(), np.float64).reshape(len(some), dim) * SCALE)
                ids, d = batch["id"].iloc[some].to_numpy(np.int64), _distances(x, pivots)
                near = d.argmin(1) if d.shape[1] and least is None else np.zeros(len(some), np.int64)
                for cell in np.unique(near).tolist():
                    at = np.flatnonzero(near == cell)
                    for a in range(0, len(at), rows):
                        part = at[a : a + rows]
                        own = held.setdefault((dim, cell), [])
                        own.append((ids[part], x[part], d[part]))
                        if sum(len(o[0]) for o in own) >= rows:
                            yield out((dim, cell))
        for cell in list(held):
            yield out(cell)

    return pack


def _matrix(blob: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.int16 if len(blob) == 2 * n * dim else np.float64).reshape(n, dim)


def _search(k: int):
    """Pairs of a query block and a data block to the k best candidates of each query."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                with np.errstate(over="ignore", invalid="ignore"):
                    yield pd.DataFrame(_pair(r, k), columns=["query_id", "vec_id", "score"])

    return search


def _upper(norms: np.ndarray, others: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Bounds of inner products from norms and least distances, safe against rounding."""
    upper = (norms + others - lower**2) / 2
    upper += 1e-9 * (1 + np.abs(upper)) + 1e-9 * (norms + others)
    return np.where(np.isfinite(upper), upper, np.inf)


def _pair(r, k: int) -> list[tuple[int, int, int]]:
    """The k best candidates at most of each query of one block among those of another."""
    q, x = _matrix(r.qx, r.qn, r.dim), _matrix(r.x, r.n, r.dim)
    qi, xi, least = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.qleast)
    exact = _exact(q.astype(np.float64), x.astype(np.float64))  # else in Python's whole numbers
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    q, x = (qf, xf) if exact else (_whole(qf), _whole(xf))
    dq, dx = np.frombuffer(r.qd).reshape(r.qn, -1), np.frombuffer(r.d).reshape(r.n, -1)
    nq, nx = _norms(qf), _norms(xf)
    found: list[tuple[int, int, int]] = []
    # The queries whose score the block may reach at all.
    far = np.zeros(r.qn)
    if dx.shape[1]:
        far = np.maximum(np.maximum(dq - dx.max(0), dx.min(0) - dq), 0).max(1)
    alive = np.flatnonzero(_upper(nq, nx.max(), far) >= least)
    if not len(alive):
        return found
    lower = np.zeros((len(alive), r.n))
    for p in range(dq.shape[1]):
        np.maximum(lower, np.abs(dq[alive, p, None] - dx[None, :, p]), out=lower)
    upper = _upper(nq[alive, None], nx[None], lower)
    for i, bound in zip(alive.tolist(), upper):
        bound[xi == qi[i]] = -np.inf
        some = np.flatnonzero((bound >= least[i]) & (bound > -np.inf))
        order = some[np.argsort(-bound[some], kind="stable")]
        best: list[tuple] = []
        for at in range(0, len(order), CHUNK):
            c = order[at : at + CHUNK]
            if len(best) == k and bound[c[0]] < -best[-1][0]:
                break
            scores = x[c] @ q[i] if exact else np.clip(x[c] @ q[i], -(2**63), 2**63 - 1)
            ok = scores >= (-best[-1][0] if len(best) == k else least[i])
            best = sorted({*best, *zip((-scores[ok]).tolist(), xi[c[ok]].tolist())})[:k]
        found += [(int(qi[i]), v, int(-s)) for s, v in best]
    return found


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of each row of df for which is_query holds."""
    spark = df.sparkSession
    tune(spark)
    usable = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ((F.abs(x.cast("double")) < float("inf"))))
    rows = df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").collect()
    dims = [len(r["v"]) for r in some]
    some = {r["id"]: r["v"] for r in some if len(r["v"]) == max(set(dims), key=dims.count)}
    ids, sample = np.array(list(some), np.int64), np.floor(np.array(list(some.values()), np.float64) * SCALE) if some else np.zeros((0, 0))
    pivots, near = sample[:1], sample[:PIVOT_SAMPLE]
    while 0 < len(pivots) < min(PIVOTS, len(near)):
        pivots = np.vstack([pivots, near[_distances(near, pivots).min(1).argmax()]])

    schema = "dim int, n int, ids binary, x binary, d binary, least binary"
    data, _ = written(rows.select("id", "v").mapInPandas(_blocks(pivots, DATA_ROWS), schema), "vectors")
    least = functools.partial(_least_scores, sample=sample, sample_ids=ids, k=k)
    queries, _ = written(rows.where("q").select("id", "v").mapInPandas(_blocks(pivots, QUERY_ROWS, least), schema), "queries")
    deals = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, min(data.count(), deals))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 7 * F.spark_partition_id()
    data = data.drop("least").withColumn("slot", F.pmod(place, F.lit(slots)).cast("int")).repartition(deals, "dim", "slot")
    queries = queries.select("dim", *[F.col(c).alias(f"q{c}") for c in ("n", "ids", "x", "d", "least")], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    queries = queries.repartition(deals, "dim", "slot")
    with arrow_rows(spark, 4):  # rows are pairs of blocks
        found, _ = written(data.join(queries.hint("merge"), ["dim", "slot"]).mapInPandas(_search(k), "query_id long, vec_id long, score long"), "found")
    found = found.distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")

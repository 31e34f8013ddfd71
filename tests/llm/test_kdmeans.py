import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from roadglass.llm import kdmeans


def brute(rows, dim=8, k=16, rounds=3):
    kept = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    own = lambda v: min((distance(v, c), i) for i, c in enumerate(centroids))[1]
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(own(v), []).append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    final = [(i, own(v), v) for i, v in kept]
    inertia = {}
    for _, c, v in final:
        inertia[c] = inertia.get(c, 0) + distance(v, centroids[c])
    top = 2**63 - 1
    cut = lambda n: min(n, top)
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, cut(distance(v, centroids[c])), cut(inertia[c]), cut(sum(inertia.values())), name(c)) for i, c, v in final), key=str)


def run(spark, rows, dim=8, parts=3, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as cluster", "'x' as ID", "2 as Distance")
    out = kdmeans.cluster(df.repartition(parts), dim=dim, **more)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def _random(n, dim=8, seed=3):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dim)]) for i in range(n)]


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kdmeans, "TREE_ROWS", 100)
    monkeypatch.setattr(kdmeans, "LEAF_ROWS", 4)
    rows = _random(500)
    rows += [(1000 + i, list(rows[7][1])) for i in range(300)]  # one vector holds a third of the rows
    rows += [(3, list(rows[3][1])), (3, [0.5] * 8), (None, [0.1] * 8), (-5, [-1.0] * 8)]  # repeated rows and ids, no id
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [math.inf] * 8), (2004, [0.5] * 7), (2005, [])]
    assert run(spark, rows) == brute(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0] * 8), (1, [-0.001] * 8)]
    assert run(spark, rows) == brute(rows)
    same = [(i, [0.25] * 8) for i in range(40)]  # empty centroids stay where they are; ties go to the smallest number
    assert run(spark, same) == brute(same) and {r[1] for r in run(spark, same)} == {0}
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [1.0])]) == []


@pytest.mark.parametrize("large", [1e6, 1e30, 1e307])
def test_numbers_of_any_size(spark, large):
    rng = random.Random(4)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * large for _ in range(8)]) for i in range(60)] + [(99, [3.0] * 8)]
    assert run(spark, rows, kind="double") == brute(rows)


def test_ids_past_doubles(spark):
    rows = [(2**62 + i, v) for i, v in _random(30)] + [(None, [0.0] * 8)]
    assert run(spark, rows, parts=1) == brute(rows)


def test_strictly_dominated_only(spark):
    """A centroid that ties in some corner of a box stays."""
    x = np.array([[0, 0], [2, 0], [0, 2], [2, 2]] * 20, np.int64)
    (r,) = kdmeans._tree(np.arange(80), np.ones(80, bool), x).itertuples(index=False)
    nodes, _, low, high, _, cs = kdmeans._read(r, np.array([[0, 0], [4, 0], [100, 100]]))
    (first, live), *_ = [(n, list(l)) for n, l in kdmeans.filtered(nodes[:1] * [1, 1, 0], low[:1], high[:1], cs)]
    assert (first, live) == (0, [0, 1])

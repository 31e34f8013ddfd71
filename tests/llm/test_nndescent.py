import math
import random

import numpy as np
import pytest

from roadglass.llm import nndescent

COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def brute(rows, link=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if g else None for g, (_, v) in zip(good, rows)]
    unit = [x / math.sqrt(x @ x) if x is not None else None for x in unit]
    links = {i: [j for j, y in enumerate(unit) if j != i and y is not None and len(y) == len(x) and x @ y >= link] if x is not None else [] for i, x in enumerate(unit)}
    comp = {}
    for i in links:
        if i not in comp:
            seen, todo = {i}, [i]
            while todo:
                todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            comp |= dict.fromkeys(seen, min(ids) if ids else None)
    return sorted(((rows[i][0], len(own), comp[i], rows[i][0] == comp[i]) for i, own in links.items()), key=str)


def run(spark, rows, parts=3, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as cls", "'x' as U", "2 as Kept", "3 as n")
    out = nndescent.near_links(df.repartition(parts))
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


def clouds(seed, dim, sizes, spread=0.1, alone=0):
    """Near copies around random centres, and vectors on their own."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dim) for _ in range(alone)]
    for n in sizes:
        centre = rng.standard_normal(dim)
        out += [centre + spread * rng.standard_normal(dim) for _ in range(n)]
    order = rng.permutation(len(out))
    return [(i, [float(np.float32(x)) for x in out[j]]) for i, j in enumerate(order)]


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [math.inf, 1.0]), (6, [0.0, 0.0]), (7, [1.0, 0.0])]
    rows += [(8, [2.0, -0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [3.0]), (12, [3.0]), (13, [0.0, -0.0])]
    rows += [(None, [1.0, 0.01]), (None, None), (None, [0.5, 0.5, 0.7]), (None, [0.5, 0.5, 0.7])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    large = [(1, [1e300, 1e299]), (2, [-1e300, 1e299]), (3, [1.0, 0.1]), (4, [1e-300, 1e-301])]
    assert run(spark, large, kind="double") == brute(large)


def test_as_brute_force(spark, monkeypatch):
    """Pairs, families larger than any list, exact copies, and rows that link with nothing."""
    monkeypatch.setattr(nndescent, "LEAF", 24)
    monkeypatch.setattr(nndescent, "LIST", 4)
    monkeypatch.setattr(nndescent, "LARGEST", 8)
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    rows = clouds(1, 24, [2] * 30 + [3] * 10 + [60, 150], alone=300)
    rows += [(5000 + i, list(rows[11][1])) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_a_chain_of_links(spark):
    """Neighbours link, others don't: one component of many direct links each."""
    rows = [(i, [math.cos(i * 0.012), math.sin(i * 0.012), 0.0]) for i in range(250)]
    assert run(spark, rows, kind="double") == brute(rows)


@pytest.mark.parametrize("orders", [1])
def test_rounds_find_what_the_orders_miss(spark, monkeypatch, orders):
    monkeypatch.setattr(nndescent, "TREES", orders)
    monkeypatch.setattr(nndescent, "LEAF", 16)
    rows = clouds(2, 16, [2] * 60 + [5] * 20, alone=400)
    df = spark.createDataFrame(rows, "vec_id long, v array<float>").selectExpr("vec_id as cls", "size(v) as dim", "1L as n", "v")
    start = nndescent._started(df, 0, orders).where("sim >= 0.95").selectExpr("least(u, v) as u", "greatest(u, v) as v").distinct().count()
    lists, _, recall = nndescent.neighbours(df)
    found = lists.where("sim >= 0.95").selectExpr("least(u, v) as u", "greatest(u, v) as v").distinct().count()
    true = sum(n for _, n, *_ in brute(rows)) // 2
    assert start < 0.9 * true and recall >= 0.99 and found >= 0.99 * true and found <= true


def test_table_of_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    assert sorted((tuple(r) for r in nndescent.near_links(df).collect()), key=str) == brute(rows)


def test_random_cases(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 300), [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(rng.choice([2, 3]))]) for _ in range(400)]
    assert run(spark, rows) == brute(rows)

import random
import re
from collections import Counter, defaultdict

import pytest

from roadglass.llm import neardedup


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute(docs, link=85):
    """Place to component by all links at the threshold."""
    sets = [shingles(t) for _, t in docs]
    places = defaultdict(list)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in places[x])
        for x in s:
            places[x].append(i)
        for j, k in common.items():
            if 100 * k >= link * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(len(sets[i]), least.get(find(i)) if sets[i] else docs[i][0]) for i in range(len(docs))]


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardedup.near_duplicates(df).collect()), key=key)
    want = sorted(((d, n, c) for (d, _), (n, c) in zip(docs, brute(docs))), key=key)
    assert got == want


def test_odd_texts(spark, odd, odd_texts):
    check(spark, odd_texts)
    got = neardedup.near_duplicates(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r["doc_id"] for r in got.where("not kept").collect()} == {5, 6, 7, 9}


def test_families_of_near_copies(spark, monkeypatch):
    """Groups around the threshold, larger than a block, with chains; compared in blocks of 16."""
    monkeypatch.setattr(neardedup, "BLOCK", 16)
    rng = random.Random(3)
    docs = []
    for f in range(4):
        words = [f"w{f}_{rng.randrange(500)}" for _ in range(120)]
        for _ in range(60):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    rng.shuffle(docs)
    check(spark, docs)


def test_bit_estimate():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([([0, -1, 5, 0], [0, -1, 5, 0], [1, -1, 5, 3])], "a array<long>, b array<long>, c array<long>")
    r = df.select(neardedup.agree("a", "b").alias("x"), neardedup.agree("a", "c").alias("y"), neardedup.estimate(neardedup.agree("a", "b")).alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == (128, 125, 1.0)


def test_empty(empty):
    assert neardedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_documents(spark, sf_documents, sf):
    check(spark, [(r["doc_id"], r["text"]) for r in sf_documents.collect()])


def test_rows_of_one_id_with_different_texts(spark):
    """The text of a class is looked up by id and text, so ids that repeat or are null mislead nothing."""
    rng = random.Random(9)
    new = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = new(), new(), new()
    check(spark, [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, c), (None, a), (4, c + " z"), (None, c), (1, c)])


def test_estimates_of_blocks():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 63), 1 << 63, (5, 4)), rng.integers(-(1 << 63), 1 << 63, (7, 4))
    b[3] = a[2]
    got = neardedup._estimates(a, b)
    bits = lambda x, k: (int(x[k // 64]) >> k % 64 & 1, int(x[2 + k // 64]) >> k % 64 & 1)
    want = [[neardedup.estimate(sum(bits(x, k) == bits(y, k) for k in range(128))) for y in b] for x in a]
    assert np.allclose(got, want) and got[2, 3] == 1

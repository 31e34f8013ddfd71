import random

import corpus_pipeline
import pytest

from roadglass.llm import neardedup
from tests.llm.test_neardedup import shingles


def components(texts, link):
    """Component of each text by all pairs of at least `link` percent; texts without words are linked with nothing."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= link * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def families():
    """Pairs of similarity 0.75 to 0.95, by words replaced far apart."""
    rng, docs = random.Random(8), []
    for f in range(40):
        words = [f"w{f}_{i}" for i in range(204)]
        own = list(words)
        for at in rng.sample(range(10, 190, 8), 2 + f % 5):
            own[at] = f"n{f}_{at}"
        docs += [" ".join(words), " ".join(own)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_links_from_eighty_percent(spark, families):
    """Of pairs between 80 and 85 percent one document stays; op3's link leaves both."""
    at80, at85 = (components([t for _, t in families], link) for link in (80, 85))
    assert len(set(at80)) < len(set(at85)) < len(families)
    first = {}
    for (d, _), c in zip(families, at80):
        first.setdefault(c, d)
    df = spark.createDataFrame(families, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(first.values())


def test_layout():
    assert neardedup.layout(85) == (25, 5, 92)
    assert neardedup.layout(80) == (32, 4, 84)
    with pytest.raises(ValueError):
        neardedup.layout(5)


def test_rows_of_null_and_repeated_ids(spark):
    """Exactly one row of each component stays, and no row goes for another row's text."""
    rng = random.Random(4)
    new = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    a, b, c, d, e, f, g = (new() for _ in range(7))
    docs = [
        (1, a), (None, a), (None, b), (None, c),  # a copy without an id takes no other text with it
        (5, d), (7, a + " x"), (7, e),  # nor does one whose id also stands for another text
        (9, f), (9, f + " y"), (9, f.upper()),  # near copies under one id
        (None, g), (None, g + " z"),  # near copies without ids
        (11, ""), (11, ""), (12, ""), (None, None), (None, None), (None, " "), (12, None),  # without words: equal rows only
    ]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(docs)], "doc_id long, text string, row int").repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    by = {}
    for (i, t), k in zip(docs, components([t for _, t in docs], 80)):
        key = ("c", k) if shingles(t) else ("w", i, t)
        by.setdefault(key, []).append((i, t))
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    left = list(rows)
    for own in by.values():
        least = min((i for i, _ in own if i is not None), default=None)
        kept = [x for x in left if x in own and x[0] == least]
        assert len(kept) == 1
        left.remove(kept[0])
    assert not left
    assert {(None, b), (None, c), (7, e), (5, d), (1, a)} <= set(rows)

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadglass.llm import queries, toxicity

INSULTS = ("blockhead", "numbskull", "dimwit", "halfwit")
PLAIN = "the a of walks runs blue green under over garden river stone light paper window morning evening market street bridge block head wit".split()


def made(n, seed, disguise=False):
    """Sentences with labels: the toxic ones hold an insult, perhaps with a character put in."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(PLAIN) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randint(5, 60))]
        y = int(rng.random() < 0.3)
        if y:
            w = rng.choice(INSULTS)
            if disguise:
                k = rng.randrange(2, len(w) - 1)
                w = w[:k] + rng.choice(["-", ".", "x", "*"]) + w[k:]
            words.insert(rng.randrange(len(words)), w)
        out.append((i, " ".join(words), y))
    return out


def test_kernel_against_definition():
    """The folded table equals the sum of kernel values with the landmarks."""
    words, marks = ["dimwit", "dim-wit", "dixmwit", "garden", "ab", "a"], ["dimwit", "halfwit"]
    with np.errstate(over="ignore"):
        k = toxicity._kernel(words, marks)

    def features(w):
        w = "\x02" + toxicity._CLEAN.sub("", w) + "\x03"
        out, total = {}, 0.0
        for a in range(len(w)):
            for b in range(a + 1, min(a + 3, len(w))):
                for c in range(b + 1, min(b + 3, len(w))):
                    for d in range(c + 1, min(c + 3, len(w))):
                        x = toxicity.LAMBDA ** (d - a - 3)
                        out[w[a] + w[b] + w[c] + w[d]] = out.get(w[a] + w[b] + w[c] + w[d], 0) + x
                        total += x * x
        return out, total**0.5

    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            (f, nf), (g, ng) = features(w), features(m)
            want = sum(x * g.get(s, 0) for s, x in f.items()) / (nf * ng) if nf and ng and len(toxicity._CLEAN.sub("", w)) > 1 else 0
            assert abs(k[i, j] - want) < 1e-4, (w, m)
    assert k[2, 0] > 3 * k[3, 0]


def test_held_out_accuracy_and_disguises():
    train = made(600, 1)
    model = toxicity.Model([(toxicity.sentences(t), y, i % 4 == 0) for i, t, y in train])
    for disguise, least in ((False, 0.99), (True, 0.9)):
        test = made(400, 2, disguise)
        s = model.scores([t for _, t, _ in test])
        assert np.mean((s >= 0.5) == [y == 1 for *_, y in test]) >= least
    s = model.scores(["you d i m w i t", None, "", "   ", "the garden", "x" * 100_000])
    assert s[0] >= 0.5 and (s[1:] < 0.5).all() and ((s >= 0) & (s <= 1)).all()


def test_labels_of_fold_0_are_not_read(spark):
    rows = made(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = [spark.createDataFrame([(i, 1 - y if flip and held(i) else y) for i, _, y in rows], "doc_id long, toxic int") for flip in (0, 1)]
    got = [toxicity.score(docs, toxicity.train(docs, x)).orderBy("doc_id").collect() for x in labels]
    assert got[0] == got[1]
    assert {r["doc_id"] for r in docs.where(toxicity.fold(F.col("doc_id")) == 0).collect()} == {i for i, *_ in rows if held(i)}


def test_odd_and_empty(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(4, 1), (4, None), (8, 0), (12, 0), (10, 0), (None, 1), (99, 1), (13, 1), (13, 0)], "doc_id long, toxic int")
    for labels in (none, some):
        out = toxicity.score(odd, toxicity.train(odd, labels), "text", "s").collect()
        assert len(out) == 17 and all(0 <= r["s"] <= 1 for r in out)
    assert toxicity.score(empty, toxicity.train(empty, some), "text", "s").count() == 0


@pytest.mark.parametrize(("sf", "accuracy", "recall"), [("sf0.01", 0.94, 0.6), ("sf0.1", 0.98, 0.9)])
def test_held_out_labels(spark, sf, accuracy, recall):
    """Accuracy on the labels that training doesn't read."""
    sf = f"/root/testdata/{sf}"
    got = queries.QUERIES["op5_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = [(r["predicted"], r["toxic"]) for r in got.where("toxic is not null").collect()]
    assert len(rows) >= 50 and sum(p == y for p, y in rows) >= accuracy * len(rows)
    assert sum(p for p, y in rows if y) >= recall * sum(y for _, y in rows)


def test_machine_against_brute_force():
    """With every word a landmark, the folded machine is the kernel machine of all words, solved by plain gradient steps."""
    good, bad = ["dimwit", "dimwits", "halfwit", "halfwits"], sorted({w + e for w in PLAIN for e in ("", "s", "ing") if len(w + e) > 1})
    words = [*good, *bad]
    model = toxicity.Model([])
    with np.errstate(over="ignore"):
        times = np.full(len(good), 5.0)
        model._solve(words, words, np.arange(len(good)), times, np.arange(len(good), len(words)))
        k = toxicity._kernel(words, words).astype(np.float64)
        got = toxicity.word_scores(words, model.table, model.bias)
    y, cost = np.array([1.0] * len(good) + [-1.0] * len(bad)), np.array([5.0] * len(good) + [0.5] * len(bad))
    # f = k a + b; ridge on the kernel norm and on b, squared hinge: least by Newton's steps on the dual weights.
    a, b = np.zeros(len(words)), 0.0
    for _ in range(50):
        on = y * (k @ a + b) < 1
        m = np.block([[k[np.ix_(on, on)] + np.diag(1 / cost[on]), np.ones((on.sum(), 1))], [np.ones((1, on.sum())), -np.eye(1)]])
        solved = np.linalg.solve(m, np.append(y[on], 0.0))
        a, b = np.zeros(len(words)), solved[-1]
        a[on] = solved[:-1]
    assert np.abs(got - (k @ a + b)).max() < 0.05, np.abs(got - (k @ a + b)).max()


def test_sentences():
    got = toxicity.sentences("You are kind. See i. d. i. o. t. there!\nLast line\n\n")
    assert [sorted(u) for u in got] == [["are", "kind", "you"], ["d.", "i.", "idiot", "o.", "see", "t.", "there"], ["last", "line"]]
    assert toxicity.sentences(None) == toxicity.sentences("") == toxicity.sentences(" \n ") == []


def test_query(spark, sf_documents):
    q = queries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.001")
    assert q.columns == ["doc_id", "held_out", "score", "predicted"] and q.count() == sf_documents.count()


def test_long_labelled_texts_are_learnt_from(spark):
    """Texts of any length teach: those of 60,000 characters and more, too."""
    rng = random.Random(12)
    filler = [". ".join(" ".join(rng.choice(PLAIN) for _ in range(12)) for _ in range(1000)) for _ in range(12)]
    rows = [(i, f"{rng.choice(filler)}. {t}. {rng.choice(filler)}", y) for i, t, y in made(160, 6)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert model.link is not None and min(len(t) for _, t, _ in rows) > 60_000
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    s = model.scores([t for t, _ in held])
    toxic = np.array([y == 1 for _, y in held])
    assert s[toxic].mean() > s[~toxic].mean()


def test_learnt_is_bounded_and_spread():
    text = ". ".join(f"word{i} thing{i} other{i % 7}" for i in range(5000))
    own = toxicity.learnt(text, 300)
    assert sum(map(len, own)) == 300 and toxicity.learnt(text, 10**6) == toxicity.sentences(text)
    places = [int(w[4:]) for u in own for w in u if w.startswith("word")]
    assert places == sorted(places) and min(places) < 1000 and max(places) > 4000
    assert sum(map(len, toxicity.learnt(" ".join(f"w{i}" for i in range(9000)), 300))) == 300
    assert toxicity.learnt(None) == []

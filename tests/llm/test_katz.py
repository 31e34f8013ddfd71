import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
import zstandard

from roadglass.llm import katz


def model(docs, train):
    """The model from plain dictionaries: log10 probability of a word after up to two, and what else a row needs."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + ["</s>"]
    one, two, three, n_docs = Counter(), Counter(), Counter(), 0
    for i, t in docs:
        if train(i):
            w = words(t)
            n_docs += 1
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w))
            three.update(zip(["<s>", *w], w, w[1:]))
    total = sum(one.values())
    factors = []
    for grams in (one, two, three):
        counts = Counter(grams.values())
        factors.append(katz.discounts([counts[r] for r in range(1, 7)]))
    d1, d2, d3 = factors
    cut = lambda d, c: d[c] if c <= 5 else 1.0
    p = {w: cut(d1, c) * c / total for w, c in one.items()}
    unknown = 1 - sum(p.values()) if total else 1.0
    if total and all(c > 5 for c in one.values()):
        p, unknown = {w: c / (total + 1) for w, c in one.items()}, 1 / (total + 1)
    seen, freed = Counter(), Counter()
    for (u, v), c in two.items():
        seen[u] += p[v]
        freed[u] += c * (1 - cut(d2, c))

    def after_one(u, v):
        if u != "<s>" and u not in one or u == "<s>" and not n_docs:
            return p.get(v, unknown)
        extra = freed[u] <= 0
        n = (n_docs if u == "<s>" else one[u]) + extra
        if c := two.get((u, v), 0):
            return cut(d2, c) * c / n
        left = 1 / n if extra else freed[u] / n
        return left / (1 - seen[u]) * p.get(v, unknown)

    for (u, v, w), c in three.items():
        seen[u, v] += after_one(v, w)
        freed[u, v] += c * (1 - cut(d3, c))

    def logp(context, w):
        if len(context) < 2 or context not in two:
            return math.log10(after_one(context[-1], w))
        extra = freed[context] <= 0
        n = two[context] + extra
        if c := three.get((*context, w), 0):
            return math.log10(cut(d3, c) * c / n)
        left = 1 / n if extra else freed[context] / n
        return math.log10(left / (1 - seen[context]) * after_one(context[-1], w))

    return words, one, two, total, logp


def contexts(w):
    return [tuple(["<s>", *w][max(0, i - 1) : i + 1]) for i in range(len(w))]


def check(spark, docs, blocks=katz.BLOCK_CHARS, **how):
    train = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 5 != 1
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = katz.score(df, lambda f: f != 1, block_chars=blocks, **how).collect()
    words, one, two, total, logp = model(docs, train)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted(((r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows), key=key)
    want = []
    for i, t in docs:
        w = words(t)
        base = sum(math.log10((one[x] + 0.5) / (total + 0.5 * (len(one) + 1))) for x in w)
        want.append((i, train(i), len(w), sum(x in one for x in w), total, base, sum(logp(c, x) for c, x in zip(contexts(w), w))))
    want.sort(key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    for c in [("<s>",), *[(w,) for w in one if w != "</s>"][:5], *[c for c in two if c[1] != "</s>"][:8], ("no", "such")]:
        assert sum(10 ** logp(c, v) for v in one) + 10 ** logp(c, "no such word") == pytest.approx(1, abs=1e-9)


def test_documents(spark, sf_documents):
    docs = [(r["doc_id"], r["text"]) for r in sf_documents.collect()]
    check(spark, docs)
    check(spark, docs, 5000)
    check(spark, docs, 20_000, bucket_chars=20_000, split=50)  # many buckets, most contexts split over them


def test_odd(spark, odd, odd_texts):
    check(spark, odd_texts)
    assert katz.score(odd, lambda f: f != 1).count() == len(odd_texts)


def test_uniform_counts(spark):
    """All counts too high to be discounted, and contexts split over buckets."""
    check(spark, [(i, "a b c a b c " * 20) for i in range(30)] + [(100, "a c b d")])


def test_no_training_rows_and_empty(spark, empty):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    check(spark, [(held, "a b c"), (held, None)])
    assert katz.score(empty, lambda f: f != 1).count() == 0


def test_discounts():
    d = katz.discounts([1000, 400, 220, 140, 100, 75])
    assert all(0 < x < 1 for x in d[1:]) and list(d[1:]) == sorted(d[1:])
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 10, 100, 5, 5, 5]):
        assert all(0 < x <= 1 for x in katz.discounts(n)[1:]) and katz.discounts(n)[1] < 1


def test_counts_past_32_bits(monkeypatch):
    """Counts over all blocks are whole, however many blocks there are."""
    held = lambda x: SimpleNamespace(value=x)
    monkeypatch.setattr("pyspark.TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    big, n = 3_000_000_000, 4
    rows = pd.concat(katz._split(1, lambda f: np.ones(len(f), bool), 10**9)(iter([pd.DataFrame({"id": [1], "text": ["a b c a b c"]})])))
    block, lists = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    histogram = katz._histogram(lists)
    words = katz.Words(histogram["c"].to_numpy()[::-1] * big * n, histogram["n"].to_numpy()[::-1])
    words.docs = big * n
    starts = pd.DataFrame({"c": histogram["c"][::-1].to_numpy(), "first": words.first[:-1]})
    answers = katz._numbered(lists, starts)
    factors = np.ones(katz.MAX_DISCOUNTED + 1)
    for order in (2, 3):
        asked = katz._asked(held(words), 1, 10**15, order)(block, answers)
        grams = len(katz.unpack(zstandard.decompress(asked["counts"][0])))
        asked["counts"] = [zstandard.compress(katz.pack(np.full(grams, big, np.uint32)))]
        many = pd.concat([asked.assign(block=k) for k in range(n)], ignore_index=True)
        reply = katz._answered(held(words), held(factors), held(factors) if order == 3 else None, order - 1)(many, pd.DataFrame(columns=["context"]))
        assert all((katz.unpack_counts(zstandard.decompress(d)) == big * n).all() for d in reply["data"])
        if order == 3:  # what a trigram backs off to was past 32 bits as well
            assert set((katz.Bucket(many, 2).lower >> 1).tolist()) == {big * n}
        answers = pd.concat([answers, reply[reply["block"] == 0]])
    for x in (np.array([], np.int64), np.array([0, 5, 2**32 - 1]), np.array([0, 2**32, 2**60])):
        assert katz.unpack_counts(katz.pack_counts(x)).tolist() == x.tolist()
    with pytest.raises(ValueError, match="different words"):
        katz.Words(np.array([1]), np.array([2**32]))

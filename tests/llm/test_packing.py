import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from roadglass.llm import packing, queries

VOCAB = P.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(VOCAB)


def check(rows, docs):
    """Each id in one piece, checksums right, sequences gapless and full; gives the number of sequences."""
    tok = library()
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        same = ids[i]
        assert len({x.tobytes() for x in same}) == 1  # repeated ids are repeated rows here
        for r in own:
            assert r["doc_tokens"] == len(same[0])
            assert zlib.crc32(same[0][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        covered = sorted((r["start"], r["length"]) for r in own)
        assert sum(n for _, n in covered) == len(same[0]) * len(same)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(len(x) for v in ids.values() for x in v)
    assert len(sequences) == -(-total // 1024)


def test_odd(odd, odd_texts):
    check(packing.pack(odd, VOCAB, P.PATTERN).collect(), odd_texts)


def test_documents(spark, sf_documents):
    check(queries.QUERIES["op9_packing"](spark, "/root/testdata/sf0.001").collect(), [(r["doc_id"], r["text"]) for r in sf_documents.collect()])


def test_empty(empty):
    assert packing.pack(empty, VOCAB, P.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_solver(seed):
    rng = np.random.default_rng(seed)
    h = np.zeros(1024, np.int64)
    h[1:] = rng.integers(0, 300, 1023) * (rng.random(1023) < [1.0, 0.3, 0.02, 1.0, 0.0][seed])
    h[700] += 50_000 * (seed == 3)
    plan = packing.solve(h)
    used = np.zeros(1024, np.int64)
    for lengths, k in plan:
        assert sum(lengths) == 1024 and 2 <= len(lengths) <= 3 and k > 0
        for n in lengths:
            used[n] += k
    assert (used <= h).all()
    if seed == 0:
        assert (used * np.arange(1024)).sum() > 0.7 * (h * np.arange(1024)).sum()


def test_ids_as_tokenizers_library():
    """The two libraries split and merge alike over all of the basic plane."""
    import tiktoken

    tok = library()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=packing.vocabulary(VOCAB), special_tokens={})
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} " for c in range(k, min(k + 64, 0x10000)) if not 0xD800 <= c < 0xE000) for k in range(0, 0x10000, 64)]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == enc.encode_ordinary(t), t


def test_added_tokens_as_tokenizers_library(spark):
    tok, end = library(), "<|endoftext|>"
    own = packing.encoder(packing.vocabulary(VOCAB), packing.added_tokens(VOCAB), P.PATTERN)
    texts = [end, f"a{end}b", f"foo {end} bar", end * 2, f" {end}\n", f"{end} x", f"x {end}", f"<|endoftext{end}|>", f"é{end}'s{end}  1", "<|endoftext |>", f"a{end[:-1]}"]
    for t in texts:
        assert own(t) == tok.encode(t, add_special_tokens=False).ids, t
    assert own(f"a{end}b") == [64, 50256, 65]
    docs = list(enumerate(texts + [f"some text {end}" * 700]))
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), VOCAB, P.PATTERN).collect(), docs)


def test_overlapping_added_tokens():
    own = packing.encoder({bytes([i]): i for i in range(256)}, {"<a": 300, "<a>": 301, "a>": 302}, P.PATTERN)
    assert own("<a>a>x<a") == [301, 302, 120, 300]


def test_solver_is_optimal():
    """No count of a combination, raised or lowered by itself, brings the sum of squares down by more than the tolerance allows."""
    import itertools

    for seed in range(4):
        rng = np.random.default_rng(seed)
        window = 48
        histogram = np.bincount(np.minimum(rng.exponential(14, 20_000).astype(int) + 1, window - 1), minlength=window)
        cols = np.array([(*c, *[0] * (3 - len(c))) for k in (2, 3) for c in itertools.combinations_with_replacement(range(1, window), k) if sum(c) == window])
        x = packing.least_squares(cols, histogram)
        assert (x >= 0).all()
        use = np.zeros((window, len(cols)))
        for j, c in enumerate(cols):
            for n in c[c > 0]:
                use[n, j] += 1
        loss = lambda v: float(((use @ v - histogram) ** 2)[1:].sum())
        gradient, square = use.T @ (histogram - use @ x), (use**2).sum(0)
        assert (np.abs(np.maximum(gradient / square, -x)) < 0.26).all()
        # The optimum, by projected gradient steps to convergence.
        y, z, t = x.copy(), x.copy(), 1.0
        rate = 1 / np.linalg.norm(use, 2) ** 2
        for _ in range(20_000):
            new = np.maximum(z + rate * (use.T @ (histogram - use @ z)), 0)
            t, momentum = (1 + (1 + 4 * t * t) ** 0.5) / 2, (t - 1) / ((1 + (1 + 4 * t * t) ** 0.5) / 2)
            z, y = new + momentum * (new - y), new
        assert loss(x) <= loss(y) + 0.01 * float((histogram[1:] ** 2).sum())


def test_most_rests_are_packed_by_the_solver():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        histogram = np.bincount(np.minimum(rng.exponential(300, 100_000).astype(int) + 1, 1023), minlength=1024)
        assert sum(k * 1024 for _, k in packing.solve(histogram)) > 0.75 * (histogram * np.arange(1024)).sum()


def test_small_chunks(odd, odd_texts, monkeypatch):
    """Ranks go on from chunk to chunk, whatever their size."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 3)
    check(packing.pack(odd, VOCAB, P.PATTERN).collect(), odd_texts)

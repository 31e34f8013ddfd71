import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from roadglass.llm import bpe, queries

RANKS = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 200, 255, 256, 70_000, 1 << 32):
        x = rng.integers(0, top, 1000, np.uint32, endpoint=False) if top < 1 << 32 else rng.integers(0, top, 1000).astype(np.uint32)
        assert (bpe.unpack(bpe.pack(x)) == x).all()
    assert len(bpe.unpack(bpe.pack(np.array([], np.uint32)))) == 0


def test_encode_as_library_and_round_trip(odd, odd_texts):
    enc = library()
    for block in (bpe.BLOCK_CHARS, 100):
        coded = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN, block_chars=block), RANKS)
        got = sorted((r["id"] or -1, np.frombuffer(r["ids"], np.uint16).tolist(), bytes(r["decoded"])) for r in coded.collect())
        want = sorted((i or -1, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_texts)
        assert got == want


def test_empty(empty):
    assert bpe.decode(bpe.encode(empty, RANKS, P.PATTERN), RANKS).count() == 0


def test_query(spark, sf_documents):
    enc = library()
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in sf_documents.collect():
        ids = enc.encode_ordinary(r["text"])
        q = got[r["doc_id"]]
        assert q["n_tokens"] == len(ids)
        assert q["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert q["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()

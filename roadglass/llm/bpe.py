"""Byte-level BPE by a global shuffle of distinct words; decoding by a join with the token-byte table.

Encoding: each block of documents is split into pre-tokens with their positions, which are kept as the
block's sequence of places in its own list of distinct words. Only the distinct words of a block are
shuffled, packed by bucket of the word's hash; where all blocks' copies of a word meet, it is encoded
once. There are as many buckets as the corpus has BUCKET_CHARS characters, so the words that a task keeps,
one bucket's, are as many at every size. The ids go back to the blocks and take their positions. The blocks are written to the shared folder once, bucketed by block,
so that they need no shuffle, and are read from there on both ways: a lost executor can't number the words
of a block anew.

Decoding: each id is looked up in the table of token bytes, which the vocabulary bounds (50,256 rows).

Null and empty texts have no tokens (null ids decode to no bytes). Repeated rows and ids are kept row by
row. Very long texts are blocks of their own. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bucketed, tune

#: Characters after which a block is closed. With more memory a larger block shuffles fewer words.
BLOCK_CHARS = 8_000_000
#: Characters of the corpus for each bucket of words, and partitions that buckets are dealt to at most.
BUCKET_CHARS = 8_000_000
MAX_PARTITIONS = 20_000


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}


def read_ranks(spark: SparkSession, path: str):
    """The rank file at `path` on the driver, as a broadcast: at most 65,536 tokens, under 2 MB."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _split_blocks(pattern: str, block_chars: int, buckets: int):
    """Rows of kind 0, one per block: doc ids and the documents' pre-tokens as places in the block's words; rows of kind 1: the block's distinct words of one bucket, in order of place."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex
        from pyspark import TaskContext

        find, task = regex.compile(pattern).findall, TaskContext.get().partitionId()
        state = {"n": 0}

        def new() -> None:
            state.update(places={}, ids=[], seqs=[], counts=[], chars=0)

        def flush() -> Iterator[pd.DataFrame]:
            block, words = (task << 24) + state["n"], list(state["places"])
            state["n"] += 1
            seq = np.concatenate(state["seqs"]) if state["seqs"] else np.zeros(0, np.uint32)
            # The commonest words get the smallest places, and the places' bytes are kept apart, which compresses well.
            order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            flat = rank[seq] if len(seq) else seq
            ids = [x is not None for x in state["ids"]]
            packed = zstandard.compress(pack(flat), 6)
            doc = np.array([x if ok else 0 for x, ok in zip(state["ids"], ids)], np.int64).tobytes()
            meta = zstandard.compress(np.int64(len(ids)).tobytes() + doc + np.array(ids, np.uint8).tobytes() + np.array(state["counts"], np.int64).tobytes())
            texts = [w.encode() for w in words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in texts), np.uint16 if buckets <= 65536 else np.uint32, len(texts))[order]
            where = zstandard.compress(bucket.tobytes(), 6)
            yield pd.DataFrame({"kind": [0], "block": [block], "bucket": [buckets], "n": [len(words)], "data": [None], "seq": [packed], "meta": [meta], "places": [where]})
            places = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[places])) + 1
            rows = []
            for part in np.split(places, cuts) if len(places) else ():
                own = [texts[j] for j in order[part].tolist()]
                sizes = np.fromiter(map(len, own), np.uint32, len(own)).tobytes()
                rows.append((1, block, int(bucket[part[0]]), len(own), zstandard.compress(sizes + b"".join(own), 6)))
            yield pd.DataFrame(rows, columns=["kind", "block", "bucket", "n", "data"]).assign(seq=None, meta=None, places=None)
            new()

        new()
        for batch in batches:
            for doc, text in zip(batch["id"].array, batch["text"].array):
                places = state["places"]
                found = find(text) if text else []
                seq = np.fromiter((places.setdefault(w, len(places)) for w in found), np.uint32, len(found))
                state["ids"].append(None if pd.isna(doc) else int(doc))
                state["seqs"].append(seq)
                state["counts"].append(len(found))
                state["chars"] += len(text or "")
                if state["chars"] >= block_chars:
                    yield from flush()
        if state["ids"]:
            yield from flush()

    return split


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, mostly small, in one, three or five bytes: 255 and 65535 say that more follow."""
    small = np.minimum(x, 255).astype(np.uint8)
    mid = x[x >= 255]
    wide = mid[mid >= 65535]
    sizes = np.array([len(small), len(mid), len(wide)], np.int64)
    m = np.minimum(mid, 65535).astype(np.uint16)
    return sizes.tobytes() + small.tobytes() + (m & 255).astype(np.uint8).tobytes() + (m >> 8).astype(np.uint8).tobytes() + wide.astype(np.uint32).tobytes()


def unpack(b: bytes) -> np.ndarray:
    n, m, k = np.frombuffer(b, np.int64, 3)
    out = np.frombuffer(b, np.uint8, n, 24).astype(np.uint32)
    mid = np.frombuffer(b, np.uint8, m, 24 + n).astype(np.uint32) | np.frombuffer(b, np.uint8, m, 24 + n + m).astype(np.uint32) << 8
    mid[mid == 65535] = np.frombuffer(b[24 + n + 2 * m :], np.uint32, k)
    out[out == 255] = mid
    return out


def _encode_words(ranks):
    """Packed words, in order of bucket, to packed ids; each distinct word is encoded once."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        # A pattern that takes any text whole: what comes here are matches of the tokenizer's pattern already.
        merged = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=parse_ranks(ranks.value), special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        current = None
        for b in batches:
            out = []
            for data, n, bucket in zip(b["data"], b["n"], b["bucket"]):
                if bucket != current:
                    known, current = {}, bucket
                blob, at, ids = zstandard.decompress(data), 4 * n, []
                for size in np.frombuffer(blob, np.uint32, n).tolist():
                    w = blob[at : at + size]
                    at += size
                    found = known.get(w)
                    if found is None:
                        found = known[w] = np.array(merged(w.decode()), np.uint16).tobytes()
                    ids.append(found)
                sizes = np.fromiter(map(len, ids), np.uint32, n) // 2
                out.append(zstandard.compress(sizes.astype(np.uint32).tobytes() + b"".join(ids), 6))
            yield pd.DataFrame({"block": b["block"], "bucket": b["bucket"], "n": b["n"], "ids": out})

    return encode


def _assembled(finish):
    """The documents of one block with their ids, by position, as `finish` leaves them."""

    def assemble(blocks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = _assemble(blocks, words)
        return finish(rows) if finish else rows

    return assemble


def _assemble(blocks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    if not len(blocks):
        return pd.DataFrame({"id": pd.Series(dtype="Int64"), "ids": []})
    row = blocks.iloc[0]
    where = zstandard.decompress(row["places"])
    bucket = np.frombuffer(where, np.uint16 if row["bucket"] <= 65536 else np.uint32)
    words = words.sort_values("bucket")
    sizes_by, flat_by = [], []
    for n, packed in zip(words["n"], words["ids"]):
        blob = zstandard.decompress(packed)
        sizes_by.append(np.frombuffer(blob, np.uint32, n))
        flat_by.append(np.frombuffer(blob, np.uint16, offset=4 * n))
    flat = np.concatenate(flat_by) if flat_by else np.zeros(0, np.uint16)
    # In order of bucket and place; then by place.
    k = np.concatenate(sizes_by).astype(np.int64) if sizes_by else np.zeros(0, np.int64)
    place = np.argsort(bucket, kind="stable")
    sizes, starts = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    sizes[place], starts[place] = k, np.cumsum(k) - k
    meta = zstandard.decompress(row["meta"])
    n = int(np.frombuffer(meta, np.int64, 1)[0])
    docs, known, counts = np.frombuffer(meta, np.int64, n, 8), np.frombuffer(meta, np.uint8, n, 8 + 8 * n), np.frombuffer(meta[8 + 9 * n :], np.int64, n)
    seq = unpack(zstandard.decompress(row["seq"]))
    ends = np.cumsum(counts)
    out = []
    for a, b in zip(ends - counts, ends):
        w = seq[a:b]
        k = sizes[w]
        at = np.cumsum(k)
        total = int(at[-1]) if len(at) else 0
        out.append(flat[np.arange(total) + np.repeat(starts[w] - (at - k), k)].tobytes())
    return pd.DataFrame({"id": pd.array(np.where(known == 1, docs, 0), "Int64").copy() if known.all() else pd.array([d if ok else None for d, ok in zip(docs.tolist(), known)], "Int64"), "ids": out})


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, finish=None, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """id and ids (binary: unsigned little-endian 16-bit ids, the vocabulary being under 65,536) of every row.

    `finish` is a function from a DataFrame of these to another, and its result's schema; it runs where the
    ids are assembled, so what it doesn't pass on needn't leave the worker.

    `ranks_path` is a file of the driver. The merges of a word are done by the tiktoken library.
    """
    spark = df.sparkSession
    tune(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // bucket_chars)
    deals = min(buckets, MAX_PARTITIONS)
    schema = "kind int, block long, bucket int, n int, data binary, seq binary, meta binary, places binary"
    made = bucketed(docs.mapInPandas(_split_blocks(pattern, block_chars, buckets), schema), "bpe_blocks", parts, "block")
    words = made.where("kind = 1").select("block", "bucket", "data", "n")
    words = words.repartition(deals, "bucket").sortWithinPartitions("bucket")
    words = words.mapInPandas(_encode_words(read_ranks(spark, ranks_path)), "block long, bucket int, n int, ids binary")
    blocks = made.where("kind = 0").select("block", "bucket", "seq", "meta", "places")
    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(_assembled(finish and finish[0]), finish[1] if finish else "id long, ids binary")


def decoder(blob: bytes):
    """From packed ids to the bytes they stand for, by lookup in the token-byte table, which the vocabulary bounds."""
    by = parse_ranks(blob)
    table = np.empty(max(by.values()) + 1, object)
    for token, i in by.items():
        table[i] = token
    return lambda ids: b"".join(table[np.frombuffer(ids, np.uint16)]) if ids else b""


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""
    ranks = read_ranks(df.sparkSession, ranks_path)

    @F.pandas_udf("binary")
    def joined(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoded = decoder(ranks.value)
        for p in parts:
            yield pd.Series([decoded(x) for x in p], dtype=object)

    return df.withColumn(column, joined(F.col(ids)))


def digests(spark: SparkSession, ranks_path: str):
    """For `encode`: number of ids, SHA-256 of the decimal ids joined by one space, and of the bytes decoded from them."""
    ranks, held = read_ranks(spark, ranks_path), {}

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        if not held:
            held["decode"], held["names"] = decoder(ranks.value), np.array([str(i) for i in range(65536)], object)
        texts = (" ".join(held["names"][np.frombuffer(x, np.uint16)]).encode() for x in rows["ids"])
        return pd.DataFrame(
            {
                "id": rows["id"],
                "n_tokens": [len(x) // 2 for x in rows["ids"]],
                "ids_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
                "decoded_sha256": [hashlib.sha256(held["decode"](x)).hexdigest() for x in rows["ids"]],
            }
        )

    return finish, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

"""Packing by non-negative least squares over shallow length combinations.

A document's ids are cut into full windows and a rest. The histogram of the rests (at most window - 1
lengths, over all documents) goes to the driver. There, all pairs and triples of present lengths that
fill a window exactly are enumerated, their repeat counts are solved against the histogram as
non-negative least squares, and rounded down. What is left over is packed greedily in order of length,
cutting a piece where a window is full, so at most one window of the whole corpus is padded. Each piece
finds its window from its rank among the pieces of its length, which is its chunk's start plus its rank
there; chunks are GROUP_PIECES pieces at most, and no length, however common, is gathered in one task.

The pieces are written to the shared folder once, so ranks stay what they are if an executor is lost.
Ids are those of the tokenizers library: the file's added tokens keep their own id inside texts as well. Null and empty
texts hold the closing id only. Repeated rows and ids are packed row by row. An empty
table gives no pieces. Other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import tune, written

WINDOW = 1024
#: Pieces that are placed at once; a document's pieces may lie in two chunks.
GROUP_PIECES = 8_000
#: Coordinate steps of the solver for each length at most; they end at their optimum well before, this only bounds the driver's work.
STEPS_PER_LENGTH = 200
#: Share of the rests by which no single count could still be bettered at the end, or a quarter of a rest.
TOLERANCE = 1e-7
ROUNDS = 3


def vocabulary(path: str) -> dict[bytes, int]:
    """The tokens' bytes and ids of a byte-level tokenizer file, without added tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in file["added_tokens"]}
    return {bytes(shown[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}


def added_tokens(path: str) -> dict[str, int]:
    """The texts that a tokenizer file keeps whole, wherever they stand in a text, and their ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that take in what is around them aren't supported")
    return {t["content"]: t["id"] for t in added}


def encoder(vocab: dict[bytes, int], added: dict[str, int], pattern: str) -> Callable[[str], list[int]]:
    """Ids of a text: its added tokens are found first (the longest where several begin), what is between them is encoded on its own."""
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
    if not added:
        return plain
    split = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")

    def encode(text: str) -> list[int]:
        if not any(token in text for token in added):
            return plain(text)
        ids: list[int] = []
        for k, part in enumerate(split.split(text)):
            ids += [added[part]] if k % 2 else plain(part)
        return ids

    return encode


def solve(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of 2 or 3 lengths that fill a window, each with its count; together within the histogram.

    histogram[n] is the number of rests of length n, 0 < n < len(histogram) = window. What rounding leaves
    over is solved again, ROUNDS times in all.
    """
    plan, left = [], histogram.astype(np.int64).copy()
    for _ in range(ROUNDS):
        more = _solve(left)
        if not more:
            break
        plan += more
        for lengths, k in more:
            for n in lengths:
                left[n] -= k
    return plan


def _solve(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    window = len(histogram)
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    if not len(have):
        return []
    present = histogram > 0
    present[0] = False
    combos = [np.array([(a, window - a, 0) for a in have.tolist() if a <= window - a and present[window - a]], np.int64).reshape(-1, 3)]
    for a in have.tolist():
        if 3 * a > window:
            break
        b = have[(have >= a) & (2 * have <= window - a)]
        b = b[present[window - a - b]]
        combos.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    cols = np.concatenate(combos)
    if not len(cols):
        return []
    x = least_squares(cols, histogram)
    avail, plan = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable").tolist():
        if x[j] < 1:
            break
        lengths = tuple(int(n) for n in cols[j] if n)
        need = {n: lengths.count(n) for n in lengths}
        k = min([int(x[j]), *(int(avail[n]) // m for n, m in need.items())])
        if k:
            for n, m in need.items():
                avail[n] -= k * m
            plan.append((lengths, k))
    return plan


def least_squares(cols: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Counts of combinations, none negative, that use each length nearest to as often as it occurs, in least squares.

    Greedy coordinate steps: always the combination whose best count changes the sum most, until none changes by more than
    TOLERANCE. This favours few combinations with large counts, which lose little by rounding.
    """
    window = len(histogram)
    left = histogram.astype(float)
    left[0] = 0
    # A length used k times in a combination counts k times; squares sum over distinct lengths.
    counts = (cols[:, :, None] == cols[:, None, :]).sum(2)
    square = np.where(cols > 0, counts, 0).sum(1).astype(float)
    x, root = np.zeros(len(cols)), np.sqrt(square)
    # The combinations that hold each length: a step changes the gradient of those of its own lengths only.
    flat = cols.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.searchsorted(flat[order], np.arange(window + 1))
    grad = left[cols].sum(1)
    least = max(0.25, TOLERANCE * left.sum())
    for _ in range(STEPS_PER_LENGTH * window):
        steps = np.maximum(grad / square, -x)
        size = np.abs(steps)
        if size.max() < least:
            break
        j = int((size * root).argmax())
        step = steps[j]
        x[j] += step
        for n in cols[j]:
            if n:
                np.subtract.at(grad, order[first[n] : first[n + 1]] // 3, step)
    return x


def _tokenised(vocab, pattern: str, end_id: int, window: int):
    """Documents to pieces: full windows with their checksums, and the rest with its ids."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(*vocab.value, pattern)
        part, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"].array, batch["text"].array):
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                full = len(ids) // window
                for k in range(full):
                    rows.append((doc, k * window, window, zlib.crc32(ids[k * window : (k + 1) * window].tobytes()), len(ids), n, None))
                    n += 1
                if len(ids) % window:
                    rest = ids[full * window :]
                    rows.append((doc, full * window, len(rest), None, len(ids), n, rest.astype("<u2").tobytes()))
                    n += 1
            out = pd.DataFrame(rows, columns=["id", "start", "length", "crc", "total", "n", "ids"])
            yield out.assign(part=part + out["n"] // GROUP_PIECES, id=out["id"].astype("Int64"), crc=out["crc"].astype("Int64"))[["part", "n", "id", "start", "length", "crc", "total", "ids"]]

    return pieces


def _placed(plan: list[tuple[tuple[int, ...], int]], histogram: np.ndarray, n_full: int, window: int):
    """From the pieces of one partition and its starts by length to their places."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(window, np.int64)
    sequence = n_full
    for lengths, k in plan:
        offset = 0
        for n in lengths:
            slots.setdefault(n, []).append((int(used[n]), sequence, offset))
            used[n] += k
            offset += n
        sequence += k
    rest = (histogram - used) * np.arange(window)
    stream = np.concatenate([[0], np.cumsum(rest)[:-1]])

    def place(pieces: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        base = dict(zip(starts["length"].tolist(), starts["before"].tolist()))
        pieces = pieces.sort_values("n")
        out = []
        for length, group in pieces.groupby("length"):
            rank = base[length] + np.arange(len(group))
            if length == window:
                out.append(group.assign(sequence=rank, offset=0))
                continue
            split = int(used[length])
            inside = rank < split
            if inside.any():
                at = np.array(slots[length], np.int64)
                own, r = group[inside], rank[inside]
                k = np.searchsorted(at[:, 0], r, "right") - 1
                out.append(own.assign(sequence=at[k, 1] + r - at[k, 0], offset=at[k, 2], crc=[zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in own["ids"]]))
            if not inside.all():
                own, pos = group[~inside], int(stream[length]) + (rank[~inside] - split) * length
                cut = []
                for row, p in zip(own.itertuples(index=False), pos.tolist()):
                    ids, a = np.frombuffer(row.ids, "<u2").astype("<u4"), 0
                    while a < length:
                        b = min(length, a + window - (p + a) % window)
                        cut.append((row.id, row.start + a, b - a, zlib.crc32(ids[a:b].tobytes()), row.total, sequence + (p + a) // window, (p + a) % window))
                        a = b
                out.append(pd.DataFrame(cut, columns=["id", "start", "length", "crc", "total", "sequence", "offset"]))
        names = ["id", "start", "length", "crc", "total", "sequence", "offset"]
        out = [x[names] for x in out]
        return pd.concat(out).astype({"id": "Int64", "crc": "int64", "sequence": "int64", "offset": "int64"}) if out else pd.DataFrame(columns=names)

    return place


def pack(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Every piece of every row: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark: SparkSession = df.sparkSession
    tune(spark)
    vocab = spark.sparkContext.broadcast((vocabulary(vocab_path), added_tokens(vocab_path)))  # as large as the vocabulary, whatever the corpus
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "part long, n long, id long, start long, length int, crc long, total long, ids binary"
    pieces, _ = written(docs.mapInPandas(_tokenised(vocab, pattern, end_id, window), schema), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = written(counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("part", "length", "before", "n"), "starts")
    histogram = np.zeros(window + 1, np.int64)
    for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r["length"]] = r["n"]
    plan = solve(histogram[:window])
    place = _placed(plan, histogram[:window], int(histogram[window]), window)
    placed = pieces.groupBy("part").cogroup(starts.groupBy("part")).applyInPandas(
        place, "id long, start long, length long, crc long, total long, sequence long, offset long"
    )
    return placed.select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset"
    )

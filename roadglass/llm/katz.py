"""Katz backoff over words: Good-Turing discounted n-grams of up to three words, exactly normalised.

P(w|u v) is the discounted relative frequency where the trigram was seen in training, else alpha(u v) * P(w|v)
where the context u v was seen, else P(w|v); P(w|v) is the same one word shorter, and P(w) the discounted
frequency of a known word; the mass that discounting frees there is the unknown word's. alpha spreads exactly
the mass that a context's seen n-grams leave over the words not seen after it. A context whose counts are all
too high to be discounted counts one observation more, so that it leaves mass. A document's first token has
the start mark as its only context, its second the mark and the first.

How it is distributed. Blocks of documents keep their token sequences as places in their own word lists
(one table in the shared folder, bucketed by block, so reading it needs no shuffle). Word lists, then lists
of distinct bigrams, then of distinct trigrams are packed by bucket of their context's hash, merged where all
blocks' lists of a bucket meet, and answered to the blocks: words by a number in the order of their counts,
n-grams by their counts, contexts by their backoff weights. A trigram carries the count of its last two words,
which its block has from the answers before, so a bucket needs no other table. There are as many buckets as
the corpus has BUCKET_CHARS characters, so what one task holds stays the same at every size.

All n-grams of a context share a bucket, so its weight is found there. Contexts of more than SPLIT tokens are
split by their next word; their sums are added up by a groupBy and joined to the context's home bucket, which
each block asks for the weight alone. Only the table of distinct word counts goes through the driver, at most
sqrt(2 * N) rows.

Counts over the corpus are of 64 bits; those within a block, which BLOCK_CHARS bounds, of 32. Different words are numbered
in 32 bits: more than 4,294,967,292 of them raise a ValueError.

Words are told apart by 64-bit hashes. Null and empty texts hold the end token only. Repeated rows and ids
are counted and scored row by row; null ids are in the fold of the text "null". An empty table gives no
rows, and without training documents every token is unknown. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bucketed_at, drop, tune, written
from ._text import batch_words, distinct, mix
from .bpe import pack, unpack

#: Counts up to which Good-Turing discounts.
MAX_DISCOUNTED = 5
#: Characters after which a block is closed. With more memory a larger block shuffles fewer words and bigrams.
BLOCK_CHARS = 6_000_000
#: Characters of the corpus for each bucket, and partitions that buckets are dealt to at most.
BUCKET_CHARS = 12_000_000
MAX_PARTITIONS = 20_000
#: Tokens of a context beyond which its n-grams are split over the buckets.
SPLIT = 200_000
#: Numbers that stand for no word: the question for a context's weight alone, the start mark, unknown words.
END, NONE, START, UNKNOWN = np.uint64(0xE5D), np.uint32(0xFFFFFFFD), np.uint32(0xFFFFFFFE), np.uint32(0xFFFFFFFF)


def _z(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 3)


def _u(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def pack_counts(x: np.ndarray) -> bytes:
    """Counts over all blocks, which may pass 32 bits; a first byte tells whether any does."""
    return b"\0" + pack(x.astype(np.uint32)) if x.max(initial=0) < 1 << 32 else b"\1" + x.astype(np.int64).tobytes()


def unpack_counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64, offset=1) if b[0] else unpack(b[1:]).astype(np.int64)


def discounts(n: list[int]) -> np.ndarray:
    """Factors of counts 0 to MAX_DISCOUNTED (0: unused), from the counts of counts 1 to MAX_DISCOUNTED + 1.

    Good-Turing by Katz's formula with the highest limit that gives factors in (0, 1]; where none does,
    absolute discounting by n1 / (n1 + 2 * n2).
    """
    out = np.ones(MAX_DISCOUNTED + 1)
    for k in range(MAX_DISCOUNTED, 0, -1):
        if not all(n[: k + 1]):
            continue
        cut = (k + 1) * n[k] / n[0]
        d = [((r + 1) * n[r] / n[r - 1] / r - cut) / (1 - cut) if cut != 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d) and d[0] < 1:
            out[1 : k + 1] = d
            return out
    gap = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out[1:] = (np.arange(1, MAX_DISCOUNTED + 1) - gap) / np.arange(1, MAX_DISCOUNTED + 1)
    return out


class Words:
    """What the driver knows of the words: distinct counts from high to low with the first number of each, and the discounts."""

    docs = 0  # training documents

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.first = counts, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.total, self.distinct = int((counts * sizes).sum()), int(sizes.sum())
        if self.distinct >= NONE:
            raise ValueError(f"{self.distinct} different words: they are numbered in 32 bits")
        by = dict(zip(counts.tolist(), sizes.tolist()))
        self.factors = discounts([by.get(r, 0) for r in range(1, MAX_DISCOUNTED + 2)])
        mass = np.where(counts <= MAX_DISCOUNTED, self.factors[np.minimum(counts, MAX_DISCOUNTED)], 1.0) * counts
        self.p = np.concatenate([mass / max(self.total, 1), [0.0]])
        self.p[-1] = 1.0 if not self.total else max(1 - float((mass * sizes).sum()) / self.total, 0.0)
        if self.total and self.p[-1] <= 0:  # no count is low enough to be discounted
            self.p = np.append(counts / (self.total + 1), 1 / (self.total + 1))

    def at(self, number: np.ndarray) -> np.ndarray:
        """Place in `counts` of a word's number; the unknown word's is one past the end."""
        k = np.searchsorted(self.first, number.astype(np.int64), "right") - 1
        return np.where(number >= START, len(self.counts), np.minimum(k, len(self.counts)))

    def count(self, number: np.ndarray) -> np.ndarray:
        return np.concatenate([self.counts, [0]])[self.at(number)]


def _split(buckets: int, train_from, block_chars: int):
    """Documents to blocks (kind 0: sequences) and their distinct words by bucket (kind 1: hashes and training counts)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, tables = TaskContext.get().partitionId(), {}
        held: list[tuple] = []
        state = {"n": 0, "chars": 0}

        def flush() -> Iterator[pd.DataFrame]:
            block = (task << 24) + state["n"]
            state["n"] += 1
            state["chars"] = 0
            tokens = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            train = np.concatenate([h[3] for h in held])
            known = np.concatenate([h[4] for h in held])
            ids = np.concatenate([h[2] for h in held])
            held.clear()
            hashes, _, seq = distinct(tokens)
            n = np.bincount(seq, minlength=len(hashes))
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            hashes, seq = hashes[order], rank[seq]
            counts = np.bincount(seq[np.repeat(train, sizes)], minlength=len(hashes))
            bucket = (hashes % np.uint64(buckets)).astype(np.uint32)
            meta = zstandard.compress(np.int64(len(ids)).tobytes() + ids.tobytes() + sizes.astype(np.int64).tobytes() + train.astype(np.uint8).tobytes() + known.astype(np.uint8).tobytes())
            yield pd.DataFrame({"kind": [0], "block": [block], "bucket": [0], "n": [len(hashes)], "data": [None], "seq": [zstandard.compress(pack(seq), 6)], "meta": [meta], "places": [_z(bucket)]})
            place = np.argsort(bucket, kind="stable")
            rows = []
            for part in np.split(place, np.flatnonzero(np.diff(bucket[place])) + 1):
                rows.append((1, block, int(bucket[part[0]]), len(part), _z(hashes[part]), None, zstandard.compress(pack(counts[part].astype(np.uint32)), 3), None))
            yield pd.DataFrame(rows, columns=["kind", "block", "bucket", "n", "data", "seq", "meta", "places"])

        for batch in batches:
            with np.errstate(over="ignore"):
                words, _, _, _, before = batch_words([(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]], True, tables)
            n = np.diff(before)
            tokens = np.insert(words, before[1:], END)
            ids = batch["id"].astype("Int64")
            known = ids.notna().to_numpy()
            fold = np.array([zlib.crc32(str(x if ok else "null").encode()) % 5 for x, ok in zip(ids.fillna(0).tolist(), known)], np.int64)
            held.append((tokens, n + 1, ids.fillna(0).to_numpy(np.int64), train_from(fold), known))
            state["chars"] += int(batch["text"].str.len().sum())
            if state["chars"] >= block_chars:
                yield from flush()
        if held:
            yield from flush()

    return split


def _merged_words(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct hashes of a bucket, their counts over all blocks, and each row's hashes."""
    own = [_u(d, np.uint64) for d in rows["data"]]
    counts = np.concatenate([unpack(zstandard.decompress(m)) for m in rows["meta"]]).astype(np.int64)
    hashes, at = np.unique(np.concatenate(own), return_inverse=True)
    return hashes, np.bincount(at, weights=counts, minlength=len(hashes)).astype(np.int64), own


def _histogram(rows: pd.DataFrame) -> pd.DataFrame:
    _, counts, _ = _merged_words(rows)
    c, n = np.unique(counts[counts > 0], return_counts=True)
    return pd.DataFrame({"bucket": rows["bucket"].iloc[0], "c": c, "n": n})


def _numbered(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """Each row's words' numbers: by count from high to low, over all buckets."""
    if not len(rows):
        return pd.DataFrame({"kind": [], "block": [], "bucket": [], "n": [], "data": [], "more": []})
    hashes, counts, own = _merged_words(rows)
    number = np.full(len(hashes), UNKNOWN, np.uint32)
    start = dict(zip(starts["c"].tolist(), starts["first"].tolist()))
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    c = counts[order]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1]) if len(c) else np.zeros(0, int)
    for a, b in zip(edge, [*edge[1:], len(c)]):
        number[order[a:b]] = start[int(c[a])] + np.arange(b - a)
    data = [_z(number[np.searchsorted(hashes, h)]) for h in own]
    return pd.DataFrame({"kind": 1, "block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "n": rows["n"].to_numpy(), "data": data, "more": None})


class Block:
    """A block's documents and tokens.

    numbers: of the block's words by place, and at the end the start mark's; place, before: each token's word and the
    one before it (the start mark at a document's first), as places.
    """

    def __init__(self, row, numbers: pd.DataFrame):
        bucket = _u(row["places"], np.uint32)
        place = np.argsort(bucket, kind="stable")
        self.numbers = np.full(len(bucket) + 1, START, np.uint32)
        self.numbers[place] = np.concatenate([_u(d, np.uint32) for d in numbers.sort_values("bucket")["data"]])
        meta = zstandard.decompress(row["meta"])
        n = int(np.frombuffer(meta, np.int64, 1)[0])
        self.ids, self.sizes = np.frombuffer(meta, np.int64, n, 8), np.frombuffer(meta, np.int64, n, 8 + 8 * n)
        self.train, self.known = np.frombuffer(meta, np.uint8, n, 8 + 16 * n) == 1, np.frombuffer(meta, np.uint8, n, 8 + 17 * n) == 1
        self.place = unpack(zstandard.decompress(row["seq"])).astype(np.int32)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty_like(self.place)
        self.before[1:] = self.place[:-1]
        self.before[self.first] = len(bucket)
        self.taught = np.repeat(self.train, self.sizes)


class Grams:
    """A block's distinct n-grams of one order, in order of bucket and context.

    tokens: those that have such an n-gram; context: each one's context, as a number below `contexts`; columns: the
    context's words, by that number; total: training tokens of the context, by that number.
    """

    def __init__(self, block: Block, tokens: np.ndarray, context: np.ndarray, columns: list[np.ndarray], total: np.ndarray, buckets: int, split: int):
        self.tokens, n, last = tokens, len(tokens), len(block.numbers)  # the last place asks for a context alone
        used = np.zeros(len(total), bool)
        used[context] = True
        hot = total > split
        asked = np.flatnonzero(used & hot)
        key = np.concatenate([context.astype(np.int64) * (last + 1) + block.place[tokens], asked * (last + 1) + last])
        key, _, inverse = distinct(key, len(total) * (last + 1))
        own = (key // np.uint64(last + 1)).astype(np.int32)
        place = (key - own.astype(np.uint64) * np.uint64(last + 1)).astype(np.int32)
        del key
        word = np.append(block.numbers, NONE)[place]
        spread = hot[own] & (word != NONE)
        bucket = home(_key([c[own] for c in columns]), buckets, np.where(spread, word.astype(np.uint64) + np.uint64(1), np.uint64(0)))
        order = bucket.astype(np.uint64) << np.uint64(32) | np.arange(len(bucket), dtype=np.uint64)
        order.sort()
        order = (order & np.uint64(0xFFFFFFFF)).astype(np.int32)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        #: Places in order of context and word, and the other way.
        self.sorted, self.rank = order, rank
        own = own[order]
        self.bucket, self.word, self.hot = bucket[order], word[order], hot[own]
        self.columns = [c[own] for c in columns]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.starts, self.run = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - np.int32(1)
        #: Of each n-gram: training tokens of its context. Of each token: its n-gram, and the run that answers for its context.
        self.total, self.gram = total[own], rank[inverse[:n]]
        home_run = np.full(len(total), -1, np.int32)
        home_run[asked] = self.run[rank[inverse[n:]]]
        self.teller = np.where(hot[own], home_run[own], self.run)

    def rows(self, block: int, counts: np.ndarray, lower: np.ndarray | None) -> pd.DataFrame:
        """The n-grams packed by bucket, with training counts and the counts of what they back off to."""
        out = []
        ends = np.append(self.starts[1:], len(self.word))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(self.bucket)]]) if len(self.bucket) else [0]
        for x, y in zip(cuts[:-1], cuts[1:]):
            a, b = np.searchsorted(self.starts, [x, y])
            first = self.starts[a:b]
            runs, hot = pack((ends[a:b] - first).astype(np.uint32)), np.packbits(self.hot[first]).tobytes()
            blob = np.array([b - a, y - x, len(runs), len(hot)], np.int64).tobytes() + runs + hot + _planes(np.diff(self.columns[0][first], prepend=np.uint32(0))) + b"".join(_planes(c[first]) for c in self.columns[1:]) + _planes(self.word[x:y])
            more = None if lower is None else zstandard.compress(pack_counts(lower[x:y]), 3)
            out.append((block, int(self.bucket[x]), zstandard.compress(blob, 3), zstandard.compress(pack(counts[x:y]), 3), more))
        return pd.DataFrame(out, columns=["block", "bucket", "data", "counts", "lower"])

    def answered(self, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of the n-grams; weights and marks of the runs."""
        answers = answers.sort_values("bucket")
        if not len(answers):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        n = np.concatenate([unpack_counts(zstandard.decompress(d)) for d in answers["data"]])
        parts = [_u(m, np.float64) for m in answers["more"]]
        return n, np.concatenate([p[: len(p) // 2] for p in parts]), np.concatenate([p[len(p) // 2 :] for p in parts])


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, those of like weight together."""
    return np.stack([(x >> np.uint32(s)).astype(np.uint8) for s in (0, 8, 16, 24)]).tobytes()


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """The words of a context, one or two, as one number."""
    out = columns[0].astype(np.uint64)
    for c in columns[1:]:
        out = out << np.uint64(32) | c
    return out


def home(key: np.ndarray, buckets: int, word: np.ndarray | int = 0) -> np.ndarray:
    """The bucket of a context, or of its n-gram with a word."""
    with np.errstate(over="ignore"):
        return (mix(mix(key) + np.uint64(0x9E3779B97F4A7C15) * word) % np.uint64(buckets)).astype(np.uint32)


def _bigrams(block: Block, words: Words, buckets: int, split: int) -> Grams:
    """Of all tokens after a known word or the start mark."""
    # Contexts in order of their numbers, so that those of a row lie close together.
    order = np.argsort(block.numbers)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    total = words.count(block.numbers)
    total[-1] = words.docs
    some = np.flatnonzero((block.numbers != UNKNOWN)[block.before]).astype(np.int32)
    return Grams(block, some, rank[block.before[some]], [block.numbers[order]], total[order], buckets, split)


def _trigrams(block: Block, two: Grams, n: np.ndarray, buckets: int, split: int) -> Grams:
    """Of all tokens after two of the same document (or one and the start mark) that training holds together."""
    context = np.full(len(block.place) + 1, -1, np.int32)
    context[two.tokens + 1] = two.gram
    context = context[:-1]
    context[block.first] = -1
    some = np.flatnonzero(context >= 0).astype(np.int32)
    some = some[n[context[some]] > 0] if len(n) else some
    # Contexts in order of their words, so that a row's first words are mostly what the one before had.
    by = two.rank
    return Grams(block, some, two.sorted[context[some]], [two.columns[0][by], two.word[by]], n[by], buckets, split)


def _asked(words, buckets: int, split: int, order: int):
    """A block's distinct n-grams with their training counts, packed by bucket."""

    def ask(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame(columns=["block", "bucket", "data", "counts", "lower"])
        row = blocks.iloc[0]
        block = Block(row, answers[answers["kind"] == 1])
        grams, lower = _bigrams(block, words.value, buckets, split), None
        if order == 3:
            n, _, extra = grams.answered(answers[answers["kind"] == 2])
            code = np.zeros(len(block.place), np.int64)
            code[grams.tokens] = (n * 2 + extra[grams.teller].astype(np.int64))[grams.gram]
            grams = _trigrams(block, grams, n, buckets, split)
            lower = np.zeros(len(grams.word), np.int64)
            taught = block.taught[grams.tokens]
            lower[grams.gram[taught]] = code[grams.tokens[taught]]
        counts = np.bincount(grams.gram[block.taught[grams.tokens]], minlength=len(grams.word)).astype(np.uint32)
        return grams.rows(int(row["block"]), counts, lower)

    return ask


class Bucket:
    """The n-grams of a bucket that training holds, and what each row asked for."""

    def __init__(self, rows: pd.DataFrame, columns: int):
        keys, runs, words, counts, lower, self.asked = [], [], [], [], [], []
        for data, c, more in zip(rows["data"], rows["counts"], rows["lower"]):
            blob = zstandard.decompress(data)
            k, n, size, bits = np.frombuffer(blob, np.int64, 4)
            at = 32
            runs.append(unpack(blob[at : at + size]).astype(np.int64))
            at += size
            hot = np.unpackbits(np.frombuffer(blob, np.uint8, bits, at), count=k).astype(bool)
            at += bits
            read = []
            for m in (*[k] * columns, n):
                planes = np.frombuffer(blob, np.uint8, 4 * m, at).reshape(4, m).astype(np.uint32)
                read.append(planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24)
                at += 4 * m
            keys.append(_key([np.cumsum(read[0], dtype=np.uint32), *read[1:-1]]))
            words.append(read[-1])
            counts.append(unpack(zstandard.decompress(c)).astype(np.int64))
            lower.append(unpack_counts(zstandard.decompress(more)) if columns > 1 else None)
            self.asked.append((hot, runs[-1]))
        self.key, _, context = distinct(np.concatenate(keys))
        self.contexts = np.split(context, np.cumsum([len(k) for k in keys])[:-1])
        word, place = distinct(np.concatenate(words), 1 << 32)[::2]
        gram = np.repeat(context.astype(np.int64), np.concatenate(runs))
        gram *= len(word)
        gram += place
        gram, _, at = distinct(gram, len(self.key) * len(word))
        # Training counts of all n-grams asked for, in the rows' order; then of those that training holds.
        counts = np.concatenate(counts)
        total = np.bincount(at, weights=counts, minlength=len(gram)).astype(np.int64)
        self.answers = np.split(total[at], np.cumsum([len(w) for w in words])[:-1])
        self.context, place = np.divmod(gram.astype(np.int64)[total > 0], len(word))
        self.count, self.word = total[total > 0], word[place].astype(np.uint32)
        self.lower = None
        if columns > 1:  # the rows of training tokens have it, all alike
            self.lower = np.zeros(len(gram), np.int64)
            self.lower[at[counts > 0]] = np.concatenate(lower)[counts > 0]
            self.lower = self.lower[total > 0]
        self.hot = np.zeros(len(self.key), bool)
        for c, (hot, _) in zip(self.contexts, self.asked):
            self.hot[c] |= hot

    def sums(self, words: Words, factors: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each context: the mass that the shorter model gives to the words seen after it, its n-grams by count 1 to MAX_DISCOUNTED, its tokens."""
        context = self.context
        if self.lower is None:
            p = words.p[words.at(self.word)]
        else:
            c, extra = self.lower >> 1, self.lower & 1
            v = words.count((self.key & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            p = discounted(c, factors) / (v[context] + extra)
        n = len(self.key)
        mass = np.bincount(context, weights=p, minlength=n)
        low = np.stack([np.bincount(context[self.count == r], minlength=n) for r in range(1, MAX_DISCOUNTED + 1)], 1)
        return mass, low, np.bincount(context, weights=self.count, minlength=n).astype(np.int64)


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.where(counts <= MAX_DISCOUNTED, factors[np.minimum(counts, MAX_DISCOUNTED)], 1.0) * counts


_SUMS = [f"l{r}" for r in range(1, MAX_DISCOUNTED + 2)]


def _surveyed(words, shorter, columns: int, buckets: int):
    """Of a bucket: its counts of counts (no context), and the sums of its split contexts with their home buckets."""

    def survey(rows: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(rows, columns)
        mass, low, tokens = b.sums(words.value, shorter and shorter.value)
        hot = np.flatnonzero(b.hot & (tokens > 0))
        out = pd.DataFrame(low[hot], columns=_SUMS[:-1]).assign(**{_SUMS[-1]: 0}, mass=mass[hot], tokens=tokens[hot], bucket=home(b.key[hot], buckets).astype(np.int64))
        out.insert(0, "context", pd.array(b.key[hot].view(np.int64), "Int64"))
        total = np.bincount(b.count[b.count <= MAX_DISCOUNTED + 1], minlength=MAX_DISCOUNTED + 2)[1:]
        total = pd.DataFrame([total], columns=_SUMS).assign(context=pd.array([None], "Int64"), mass=0.0, tokens=0, bucket=0)
        return pd.concat([total[out.columns], out])

    return survey


def _weights(mass: np.ndarray, low: np.ndarray, total: np.ndarray, factors: np.ndarray):
    """Backoff weights of contexts, and whether each counts one observation more."""
    freed = (low * np.arange(1, MAX_DISCOUNTED + 1) * (1 - factors[1:])).sum(1)
    extra, total = freed <= 0, np.maximum(total, 1)
    return np.where(extra, 1 / (total + 1), freed / total) / np.maximum(1 - mass, 1e-300), extra


def _answered(words, factors, shorter, columns: int):
    """Each row's answer: its n-grams' counts (0: unseen), and its contexts' backoff weights and marks."""
    names = ["kind", "block", "bucket", "n", "data", "more"]

    def answer(rows: pd.DataFrame, split: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=names)
        b = Bucket(rows, columns)
        mass, low, tokens = b.sums(words.value, shorter and shorter.value)
        if len(split):  # the whole sums of the contexts that have their home here
            keys = split["context"].to_numpy(np.int64).view(np.uint64)
            at = np.minimum(np.searchsorted(b.key, keys), len(b.key) - 1)
            ok = b.key[at] == keys
            at = at[ok]
            mass[at], low[at], tokens[at] = split["mass"].to_numpy(float)[ok], split[_SUMS[:-1]].to_numpy(np.int64)[ok], split["tokens"].to_numpy(np.int64)[ok]
        alpha, extra = _weights(mass, low, tokens, factors.value)
        alpha, extra = np.where(tokens > 0, alpha, 1.0), extra & (tokens > 0)
        data, more = [], []
        for context, n, (_, runs) in zip(b.contexts, b.answers, b.asked):
            missed = np.add.reduceat((n == 0).astype(np.int64), np.cumsum(runs) - runs) > 0
            data.append(zstandard.compress(pack_counts(n), 3))
            more.append(_z(np.concatenate([np.where(missed, alpha[context], 0.0), extra[context].astype(np.float64)])))
        return pd.DataFrame({"kind": 1 + columns, "block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "n": [len(n) for n in b.answers], "data": data, "more": more})

    return answer


def _scored(words, factors, buckets: int, split: int):
    """The documents of one block with their scores."""
    columns = ["id", "train", "n_tokens", "n_known", "base_score", "score"]

    def backed(log: np.ndarray, grams: Grams, answers: pd.DataFrame, factor: np.ndarray) -> np.ndarray:
        """log10 probabilities of one order from those of the order below; and the counts of the n-grams."""
        n, weight, extra = grams.answered(answers)
        if len(grams.tokens):
            with np.errstate(divide="ignore"):
                longer = np.log10(discounted(n, factor)) - np.log10(grams.total + extra[grams.teller])
                shorter = np.log10(weight[grams.teller])
            log[grams.tokens] = np.where((n > 0)[grams.gram], longer[grams.gram], shorter[grams.gram] + log[grams.tokens])
        return n

    def score(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame(columns=columns)
        w, block = words.value, Block(blocks.iloc[0], answers[answers["kind"] == 1])
        at = w.at(block.numbers)
        counts = np.concatenate([w.counts, [0]])[at]
        sums = lambda by_place: np.add.reduceat(by_place[block.place], block.first)
        out = {"id": pd.array([i if ok else None for i, ok in zip(block.ids.tolist(), block.known)], "Int64"), "train": block.train, "n_tokens": block.sizes}
        out |= {"n_known": sums((counts > 0).astype(np.int32)).astype(np.int64), "base_score": sums(np.log10((counts + 0.5) / (w.total + 0.5 * (w.distinct + 1))))}
        log = np.log10(w.p[at])[block.place]
        grams = _bigrams(block, w, buckets, split)
        n = backed(log, grams, answers[answers["kind"] == 2], factors[2].value)
        grams = _trigrams(block, grams, n, buckets, split)
        del n
        backed(log, grams, answers[answers["kind"] == 3], factors[3].value)
        return pd.DataFrame(out | {"score": np.add.reduceat(log, block.first)})

    return score


def score(df: DataFrame, train_from, id_col: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, bucket_chars: int = BUCKET_CHARS, split: int = SPLIT) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score, score of every row.

    `train_from` tells from an array of crc32(id as text) modulo 5 which rows to learn from.
    """
    spark = df.sparkSession
    tune(spark)
    send = spark.sparkContext.broadcast
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fold = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("null"))) % 5
    folds = docs.groupBy(fold.alias("f")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()  # at most 5 rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, sum(r["chars"] for r in folds) // bucket_chars)
    deals = min(buckets, MAX_PARTITIONS)
    made = docs.mapInPandas(_split(buckets, train_from, block_chars), "kind int, block long, bucket int, n int, data binary, seq binary, meta binary, places binary")
    made, made_path = bucketed_at(made, "lm_blocks", parts, "block", apart="kind")
    lists = made.where("kind = 1").select("block", "bucket", "n", "data", "meta")
    blocks = made.where("kind = 0").select("block", "seq", "meta", "places")

    histogram, _ = written(lists.groupBy("bucket").applyInPandas(_histogram, "bucket int, c long, n long"), "histogram")
    by_count = histogram.groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c")).collect()  # at most sqrt(2 * N) rows
    w = Words(np.array([r["c"] for r in by_count], np.int64), np.array([r["n"] for r in by_count], np.int64))
    w.docs = sum(r["n"] for r in folds if train_from(np.array([r["f"]]))[0])
    words = send(w)

    # The first number of each count in each bucket.
    within = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = spark.createDataFrame([(int(c), int(f)) for c, f in zip(w.counts, w.first)], "c long, f long")
    starts = histogram.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(first, "c").select("bucket", "c", (F.col("f") + F.col("before")).alias("first"))
    schema = "kind int, block long, bucket int, n int, data binary, more binary"
    answers, _ = written(lists.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInPandas(_numbered, schema), "numbers")
    drop(spark, f"{made_path}/kind=1")  # the lists are numbered

    factors: dict = {2: None, 3: None}
    for order in factors:
        columns, shorter = order - 1, factors.get(order - 1)
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_asked(words, buckets, split, order), "block long, bucket int, data binary, counts binary, lower binary")
        asked, asked_path = bucketed_at(asked.repartition(deals, "bucket"), "lm_grams", deals, "bucket")
        sums = ", ".join(f"{c} long" for c in _SUMS)
        survey = asked.groupBy("bucket").applyInPandas(_surveyed(words, shorter, columns, buckets), f"context long, {sums}, mass double, tokens long, bucket long")
        survey, _ = written(survey, "survey")
        survey = survey.groupBy("context", "bucket").agg(*[F.sum(c).alias(c) for c in [*_SUMS, "mass", "tokens"]])
        seen = survey.where("context is null").first()
        factors[order] = send(discounts([int(seen[c] or 0) if seen else 0 for c in _SUMS]))
        whole = survey.where("context is not null").withColumn("bucket", F.col("bucket").cast("int"))
        replies = asked.groupBy("bucket").cogroup(whole.groupBy("bucket")).applyInPandas(_answered(words, factors[order], shorter, columns), schema)
        if order == 2:
            replies, _ = written(replies, "replies")
            drop(spark, asked_path)
        answers = answers.unionByName(replies)
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _scored(words, factors, buckets, split), "id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(w.total).cast("long").alias("train_tokens"), "base_score", "score")

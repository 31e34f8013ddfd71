"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of four characters of two words (with marks for both ends), each gap
of a skipped character costing a factor LAMBDA, so insults with inserted or missing characters and their
inflections stay near each other. The machine is trained on labelled sentences: a sentence is a bag of words,
cleaned of punctuation, runs of single characters joined, and has the value of its highest word, which is the
latent part. A sentence of a clean document is to stay below -1, so each of its words is; of a toxic document
the sentence that speaks most for the label is its witness and is to rise above 1 by its word (first by the
log-odds of the words, then by the machine itself), and so are words as good as never seen in other documents.

The first two turns, which only choose witnesses, take the FIRST_WORDS highest clean words. The last is solved
for all of them, by Newton steps whose sums go over CHUNK words at a time and leave out those that are beyond
the margin, so it holds the features of few words at once. It works in the space of the Nyström landmarks; as the kernel is a sum over subsequences, the trained machine
is folded into one weight for each (hashed) subsequence, and scoring a word is a sum of table entries. A
logistic model over a document's two highest words, fitted on labelled documents that training didn't see,
gives the score; on the documents of sf0.1, two words tell more than two sentences do (3 false alarms, not 12).

Labels are learnt from at most TRAIN_ROWS labelled documents of each label, by hash of the id, whatever their length;
of one with more than TRAIN_WORDS words in its sentences, from a sample of its sentences over its whole length, by hash.
These are the only samples, and they bound what the one task holds that trains the machine; only the model goes to the driver. Scoring reads every word of every text. Null and empty texts have no words and get a low score. Repeated rows are scored alike; of
labels that repeat an id the highest holds, of texts that repeat it the least; rows without an id are never
learnt from. Without labels of both kinds every score is 0. Other columns are not looked at. Words of any
length are read whole, long ones in overlapping windows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import tune

#: Labelled documents of either label that are used at most, and the words of one that are learnt from at most.
TRAIN_ROWS, TRAIN_WORDS = 3000, 1000
#: Highest clean words that the machine of the first turns is solved for; words whose features are held at once.
FIRST_WORDS, CHUNK = 4000, 4096
LAMBDA = 0.5
LANDMARKS = 320
#: Newton steps at most; they end when no word enters or leaves the margin.
NEWTON = 12
#: Log-odds from which a word counts as toxic in each toxic document that holds it.
STRONG = 3.5
BITS = 20
WINDOW = 32
#: Score of a document without words, as its highest word's.
NO_WORD = -3.0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CLEAN = re.compile(r"[\W_]+")
_GAPS = list(itertools.product((0, 1), repeat=3))


def units(text: str | None) -> set[str]:
    """The cleaned words of a text, and its runs of three or more single characters joined."""
    words = _WORD.findall(text.lower()) if text else []
    out = set(words)
    if sum(len(w) < 3 for w in words) > 2:
        run: list[str] = []
        for w in itertools.chain(words, ("   ",)):
            one = w if len(w) == 1 else _CLEAN.sub("", w) if len(w) == 2 else ""
            if len(one) == 1:
                run.append(one)
            else:
                if len(run) > 2:
                    out.add("".join(run))
                run = []
    return out


#: A sentence's end: marks after a word of three letters or more (those of a spelt-out word are none), or a line's.
_END = re.compile(r"(?<=\w\w\w)(?:[.!?]+\s+|\s*\n\s*)")


def sentences(text: str | None) -> list[set[str]]:
    """The units of each sentence of a text that has any."""
    return [u for u in map(units, _END.split(text)) if u] if text else []


def _hashed(words: Iterable[str]) -> int:
    return zlib.crc32("\0".join(sorted(words)).encode("utf-8", "surrogatepass"))


def learnt(text: str | None, most: int = TRAIN_WORDS) -> list[set[str]]:
    """The sentences of a text that are learnt from: all, or those of least hash up to `most` words; in their order."""
    own = sentences(text)
    if sum(map(len, own)) <= most:
        return own
    kept, left = {}, most
    for i in sorted(range(len(own)), key=lambda i: (_hashed(own[i]), i)):
        if left <= 0:
            break
        # A sentence that is longer than what is left gives its words of least hash.
        kept[i] = own[i] if len(own[i]) <= left else set(sorted(own[i], key=lambda w: (_hashed([w]), w))[:left])
        left -= len(kept[i])
    return [kept[i] for i in sorted(kept)]


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled texts to what is learnt from them: a line a sentence, its words apart by spaces, which words don't hold."""
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "fold": batch["fold"], "words": ["\n".join(" ".join(sorted(u)) for u in learnt(t)) for t in batch["t"]]})


def _codes(words: list[str]):
    """By length: places in `words`, hashed subsequences (a row for each word), weights, the rows' norm."""
    by: dict[int, list[tuple[int, str]]] = {}
    for i, w in enumerate(words):
        w = _CLEAN.sub("", w)
        if len(w) <= WINDOW:
            by.setdefault(len(w), []).append((i, w))
        else:
            for at in range(0, len(w) - WINDOW // 2, WINDOW // 2):
                part = w[at : at + WINDOW]
                by.setdefault(len(part), []).append((i, part))
    for n, own in by.items():
        if n < 2:
            continue
        c = np.empty((len(own), n + 2), np.uint64)
        c[:, 0], c[:, -1] = 2, 3
        c[:, 1:-1] = np.frombuffer("".join(w for _, w in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        codes, weights = [], []
        for g in _GAPS:
            a, b, d = 1 + g[0], 2 + g[0] + g[1], 3 + sum(g)
            m = n + 2 - d
            if m <= 0:
                continue
            code = c[:, :m]
            for k in (a, b, d):
                code = code * np.uint64(0x100000001B3) + c[:, k : k + m]
            codes.append(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
            weights.append(np.full(m, LAMBDA ** sum(g), np.float32))
        if codes:
            weight = np.concatenate(weights)
            yield np.array([i for i, _ in own]), np.concatenate(codes, 1), weight, float(np.sqrt((weight**2).sum()))


def word_scores(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of each word."""
    out = np.full(len(words), NO_WORD, np.float32)
    with np.errstate(over="ignore"):
        for rows, codes, weight, norm in _codes(words):
            for a in range(0, len(rows), 20_000):
                part = slice(a, a + 20_000)
                np.maximum.at(out, rows[part], (table[codes[part]] @ weight) / norm + bias)
    return out


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words with landmarks."""
    place = np.zeros(1 << BITS, np.int32)
    found = list(_codes(landmarks))
    used = np.unique(np.concatenate([c.ravel() for _, c, _, _ in found]))
    place[used] = np.arange(1, len(used) + 1)
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for rows, codes, weight, norm in found:
        for i, c in zip(rows, codes):
            np.add.at(dense[:, i], place[c], weight / norm)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for rows, codes, weight, norm in _codes(words):
        for a in range(0, len(rows), 512):
            part = slice(a, a + 512)
            out[rows[part]] = np.einsum("rtm,t->rm", dense[place[codes[part]]], weight / norm)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Intercept and two slopes, none below 0, of weighted rows, by Newton steps with a small ridge."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 0.05 * np.eye(3), x.T @ (weight * (y - p)) - 0.05 * w)
        w += np.clip(step, -3, 3)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-7:
            break
    return w


class Model:
    """A trained model: the table of subsequence weights, its bias, and the logistic model."""

    def __init__(self, docs: Iterable[tuple[list[set[str]], int, bool]], rates: tuple[float, float] = (1.0, 1.0)):
        """docs: sentences, label, and whether the document is for the logistic model only. Words are kept once.

        rates: how many labelled documents each one of either label stands for.
        """
        self.table, self.bias, self.link = np.zeros(1 << BITS, np.float32), 0.0, None
        index: dict[str, int] = {}
        fit, later = [], []
        for own, y, after in docs:
            rows = [np.fromiter((index.setdefault(w, len(index)) for w in sorted(u)), np.int32, len(u)) for u in own]
            (later if after else fit).append((rows, y))
        words = list(index)
        if not all(any(y == k for _, y in fit) for k in (0, 1)):
            return
        if not all(any(y == k for _, y in later) for k in (0, 1)):
            later = fit
        with np.errstate(over="ignore"):
            self._train(words, [(own, y) for own, y in fit if own])
            value = word_scores(words, self.table, self.bias)
        x = np.array([_two(value[np.unique(np.concatenate(own))] if own else value[:0]) for own, _ in later])
        y = np.array([y for _, y in later])
        self.link = _logistic(x, y.astype(float), np.array(rates)[y])

    def _train(self, words: list[str], docs: list[tuple[list[np.ndarray], int]]) -> None:
        # Documents of either label that hold a word, and its log-odds, less where few hold it.
        seen = np.zeros((2, len(words)), np.float32)
        bags = [(np.unique(np.concatenate(own)), y) for own, y in docs]
        for bag, y in bags:
            seen[y, bag] += 1
        n = np.array([sum(y == k for _, y in bags) for k in (0, 1)], np.float32)
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        odds *= np.minimum(seen[1] / 4, 1)
        clean = np.flatnonzero(seen[0])
        for turn in range(3):
            value = word_scores(words, self.table, self.bias) if turn else odds
            speaks = value + 0.3 * odds if turn else odds
            pick: list[int] = []
            for (own, y), (bag, _) in zip(docs, bags):
                if y:
                    best = [u[np.argmax(speaks[u])] for u in own]
                    witness = best[int(np.argmax(speaks[best]))]
                    # A document none of whose sentences speaks for its label teaches nothing.
                    pick += [int(witness)] * bool(odds[witness] > 1) + bag[odds[bag] > STRONG].tolist()
            if not pick:
                return
            chosen, times = np.unique(pick, return_counts=True)
            order = clean[np.argsort(-value[clean], kind="stable")]
            top = chosen[np.argsort(-times, kind="stable")]
            marks = [words[i] for i in [*top[: LANDMARKS * 2 // 3], *order[: LANDMARKS // 3]] if len(words[i]) > 1]
            if not marks:
                return
            self._solve(words, marks, chosen, times * 3000.0 / len(pick), order if turn == 2 else order[:FIRST_WORDS])

    def _solve(self, words: list[str], marks: list[str], chosen: np.ndarray, times: np.ndarray, clean: np.ndarray) -> None:
        """The squared-hinge machine of the chosen words against the clean ones, in the landmarks' space, folded into the table.

        Newton steps on the rows within the margin, which nearly all clean words are: their sums are those of all
        clean words less those of the few beyond it.
        """
        mid = _kernel(marks, marks).astype(np.float64)
        values, vectors = np.linalg.eigh((mid + mid.T) / 2)
        keep = values > 1e-3 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])

        def features(of: np.ndarray) -> np.ndarray:
            return np.hstack([_kernel([words[i] for i in of], marks) @ root, np.ones((len(of), 1))])

        def sums(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            square, total = np.zeros((root.shape[1] + 1,) * 2), np.zeros(root.shape[1] + 1)
            for a in range(0, len(of), CHUNK):
                x = features(of[a : a + CHUNK])
                square += 0.5 * (x.T @ x)
                total += 0.5 * x.sum(0)
            return square, total

        good, cost = features(chosen), np.maximum(times, 2.0)
        every, folded = sums(clean), list(_codes(marks))
        beyond, w = np.zeros(0, np.int64), np.zeros(root.shape[1] + 1)
        for _ in range(NEWTON):
            out = sums(beyond)
            near = good @ w < 1
            x = good[near] * cost[near, None]
            w = np.linalg.solve(every[0] - out[0] + good[near].T @ x + np.eye(len(w)), x.sum(0) - every[1] + out[1])
            beta = root @ w[:-1]
            self.table, self.bias = np.zeros(1 << BITS, np.float32), float(w[-1])
            for at, codes, weight, norm in folded:
                for i, c in zip(at, codes):
                    np.add.at(self.table, c, (beta[i] * weight / norm).astype(np.float32))
            before, beyond = beyond, clean[word_scores([words[i] for i in clean], self.table, self.bias) < -1]
            if len(before) == len(beyond) and (before == beyond).all() and ((good @ w < 1) == near).all():
                break

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts, 0 to 1."""
        if self.link is None:
            return np.zeros(len(texts))
        place: dict[str, int] = {}
        bags = [np.fromiter((place.setdefault(w, len(place)) for w in u), np.int64, len(u)) for u in map(units, texts)]
        value = word_scores(list(place), self.table, self.bias)
        x = np.array([_two(value[b]) for b in bags]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.link[0] + x @ self.link[1:], -30, 30)))


def _two(values: np.ndarray) -> tuple[float, float]:
    """The two highest values, within bounds."""
    best = np.sort(np.concatenate([values, [NO_WORD, NO_WORD]]))[-2:] if len(values) < 2 else np.partition(values, len(values) - 2)[-2:]
    best = np.clip(best, NO_WORD, 3)
    return float(best[1]), float(best[0])


def fold(id_col: Column) -> Column:
    """crc32 of the id as text ("null" for none), modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled documents outside fold 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("fold", fold(F.col("id"))).where("fold <> 0")
    some = [known.where(f"y = {k}").orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    some = some[0].unionByName(some[1])  # at most 2 * rows narrow rows: small enough to broadcast, by construction
    found = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    found = found.join(F.broadcast(some), "id").groupBy("id", "y", "fold").agg(F.min("t").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = found.mapInPandas(_learn, f"id {kind}, y int, fold long, words string")
    all_ = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    rates = tuple(max(1.0, all_.get(k, 0) / rows) for k in (0, 1))
    # 2 * rows documents of TRAIN_WORDS words at most, in one task; only the model goes to the driver.
    made = found.repartition(1).mapInPandas(_fitted(rates), "table binary, bias double, link array<double>").collect()
    model = Model([])
    if made and made[0]["link"]:
        model.table, model.bias, model.link = np.frombuffer(zlib.decompress(made[0]["table"]), np.float32), made[0]["bias"], np.array(made[0]["link"])
    return model


def _fitted(rates: tuple[float, float]):
    """All that is learnt from to one trained model."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted(itertools.chain.from_iterable(zip(b["id"].tolist(), b["words"], b["y"].tolist(), b["fold"].tolist()) for b in batches), key=lambda r: r[0])
        model = Model((([set(u.split(" ")) for u in own.split("\n") if u], y, f == 1) for _, own, y, f in got), rates)
        yield pd.DataFrame({"table": [zlib.compress(model.table.tobytes(), 1)], "bias": [model.bias], "link": [None if model.link is None else model.link.tolist()]})

    return fit


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """df with the score of every row's text."""
    spark = df.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model)  # as large as 2**BITS weights, whatever the corpus

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(texts.tolist()))

    return df.withColumn(column, scored(F.col(text)))

"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct 5-word shingles. Documents of equal sets form a class at once. Each
class has 128 minima: they make the keys of the bands that `layout` derives from the threshold, and the two
low bits of all 128 are packed as a signature of four longs. Classes that share a band are candidates: the
bit counts of their signatures, corrected for chance agreement, estimate the similarity, and candidates
within six standard deviations of the threshold are confirmed on the full sets. Confirmed links make the
components.

No band emits all its pairs. First each class of a band is paired with the band's pivot only. Of bands that
then still hold several components, the classes outside the largest one are compared with all others, in
blocks of about BLOCK classes: two blocks at once, first by the signatures' estimate, then, for the rows that
pass, by a product of their shingle-incidence matrices over 16-bit shingle hashes (which can't miss a link),
and only pairs of different components that reach the threshold in both leave the comparison, to be confirmed
as well. Pairs within a component can't change the result. A link at the threshold shares no band with
probability 4e-7 at 85 (25 bands of 5) and 5e-8 at 80 (32 bands of 4), and misses the estimate with 1e-9.

Null texts and texts without words are linked with nothing. Null ids take part but never name a component
unless all its ids are null. Repeated rows are exact copies, and rows of one id may hold different texts. An
empty table gives no rows. Texts of any length are read whole. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, drop, tune, written
from ._text import batch_shingles, batch_words, mix

K_WORDS = 5
N_MINIMA = 128
PLANES = 4  # two low bits of 128 minima: longs
#: Probability that a link at the threshold shares no band, at most.
MISS = 4.5e-7
#: Classes of a block, about.
BLOCK = 256
#: A link: 100 * intersection >= link * union. This is the link of op3's contract.
LINK = 85


def layout(link: int) -> tuple[int, int, int]:
    """Bands, minima of a band, and agreeing minima that a link at the threshold reaches but for six standard deviations."""
    s = link / 100
    rows = next((r for r in range(N_MINIMA, 0, -1) if (1 - s**r) ** (N_MINIMA // r) <= MISS), 0)
    if not rows or link > 100:
        raise ValueError(f"no bands of {N_MINIMA} minima find links at {link} percent")
    p = s + (1 - s) / 4  # two low bits agree by chance in 1 of 4
    return N_MINIMA // rows, rows, int(N_MINIMA * p - 6 * (N_MINIMA * p * (1 - p)) ** 0.5)


def _sets(texts: list[str | None], tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    words, _, _, _, before = batch_words([(t or "").encode("utf-8", "surrogatepass") for t in texts], True, tables)
    sh, at = batch_shingles(words, before, K_WORDS)
    parts = [np.unique(sh[a:b]) for a, b in zip(at[:-1], at[1:])]
    return (np.concatenate(parts) if parts else sh), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _class_keys(sets: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """16 bytes that equal sets share, whatever their order."""
    sums = [np.add.reduceat(mix(sets ^ np.uint64(salt)), begin) for salt in (0, 0x5851F42D4C957F2D)]
    return [c.tobytes() for c in np.stack(sums, 1)]


def _signatures(n_bands: int, n_rows: int, seed: int = 7):
    """id, hash, class (16 bytes; null without words), set size, band keys, signature of every text."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            rng, tables = np.random.default_rng(seed), {}
            flips = rng.integers(0, 1 << 63, N_MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
            odds = rng.integers(0, 1 << 63, N_MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
            for batch in batches:
                sets, at = _sets(batch["text"].tolist(), tables)
                sizes = np.diff(at)
                some = np.flatnonzero(sizes)
                begin = at[:-1][some]
                out = pd.DataFrame({"id": batch["id"].astype("Int64"), "h": batch["h"], "cls": None, "n": sizes, "bands": None, "planes": None})
                if len(some):
                    minima = np.empty((N_MINIMA, len(some)), np.uint64)
                    for k in range(N_MINIMA):
                        minima[k] = np.minimum.reduceat((sets ^ flips[k]) * odds[k], begin)
                    keys = np.empty((len(some), n_bands), np.uint64)
                    for b in range(n_bands):
                        h = np.full(len(some), b + 1, np.uint64)
                        for r in range(n_rows):
                            h = mix(h ^ minima[b * n_rows + r]) + np.uint64(b)
                        keys[:, b] = h
                    spread = mix(minima)
                    bits = np.concatenate([(spread & np.uint64(1)), (spread >> np.uint64(1)) & np.uint64(1)]).astype(np.uint8)
                    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(np.int64)
                    for name, values in (("cls", _class_keys(sets, begin)), ("bands", list(keys.view(np.int64))), ("planes", list(planes))):
                        filled = np.full(len(batch), None, object)
                        for i, v in zip(some, values):
                            filled[i] = v
                        out[name] = filled
                yield out

    return sign


def agree(a: str, b: str) -> Column:
    """Minima whose low bits agree, from two signatures."""
    half = PLANES // 2
    differ = [
        F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]).bitwiseOR(F.col(a)[i + half].bitwiseXOR(F.col(b)[i + half])))
        for i in range(half)
    ]
    return F.lit(N_MINIMA) - sum(differ[1:], differ[0])


def estimate(agreeing):
    """The similarity that so many agreeing pairs of low bits stand for (a column, an array or a number), corrected for chance (1 in 4)."""
    return (agreeing / N_MINIMA - 0.25) / 0.75


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of all signatures of a with all of b."""
    half, differ = PLANES // 2, 0
    a, b = a.view(np.uint64), b.view(np.uint64)
    for i in range(half):
        differ = differ + np.bitwise_count((a[:, None, i] ^ b[None, :, i]) | (a[:, None, i + half] ^ b[None, :, i + half])).astype(np.int16)
    return estimate(N_MINIMA - differ)


def _confirm(link: int):
    """Pairs that are links, by their full sets."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict = {}
        with np.errstate(over="ignore"):
            for batch in batches:
                sets, at = _sets(batch["ta"].tolist() + batch["tb"].tolist(), tables)
                n, ok = len(batch), []
                for i in range(n):
                    a, b = sets[at[i] : at[i + 1]], sets[at[n + i] : at[n + i + 1]]
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(100 * common >= link * (len(a) + len(b) - common))
                yield batch.loc[ok, ["a", "b"]]

    return confirm


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds each text's distinct 16-bit shingle hashes."""
    tables: dict = {}
    with np.errstate(over="ignore"):
        for batch in batches:
            sets, at = _sets(batch["text"].tolist(), tables)
            short = (sets >> np.uint64(17)).astype(np.uint16)
            yield batch.assign(short=[np.unique(short[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])])


_HEAD, _BODY = ["key", "main", "block", "mains", "others"], ["cls", "root", "n", "lens", "planes", "sets"]


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of band and block to one row a block: classes, roots, set sizes, sizes of the short sets, signatures, short sets."""

    def pack(head: tuple, columns: list[list]) -> tuple:
        cls, root, n, planes, short = columns
        lens = np.fromiter(map(len, short), np.int64, len(short)) // 2
        return (*head, b"".join(cls), b"".join(root), np.array(n, np.int64).tobytes(), lens.tobytes(), np.array(planes, np.int64).tobytes(), b"".join(short))

    names = ["cls", "root", "n", "planes", "short"]
    held: tuple | None = None
    columns: list[list] = [[] for _ in names]
    for batch in batches:
        if not len(batch):
            continue
        heads = list(zip(*[batch[c].tolist() for c in _HEAD]))
        values = [batch[n].tolist() for n in names]
        out, at = [], 0
        while at < len(heads):
            end = at + 1
            while end < len(heads) and heads[end] == heads[at]:
                end += 1
            if held is not None and held != heads[at]:
                out.append(pack(held, columns))
                columns = [[] for _ in names]
            held = heads[at]
            for own, v in zip(columns, values):
                own += v[at:end]
            at = end
        yield pd.DataFrame(out, columns=[*_HEAD, *_BODY])
    if held is not None:
        yield pd.DataFrame([pack(held, columns)], columns=[*_HEAD, *_BODY])


def _compared(link: int, least: float):
    """Pairs of two blocks' classes, of different components, that may be links."""
    kinds = ("V16", "V16", np.int64, np.int64, np.int64)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: set[tuple[bytes, bytes]] = set()
            for r in batch.to_dict("records"):
                sides = [[*[np.frombuffer(r[c + end], kind) for c, kind in zip(_BODY, kinds)], np.frombuffer(r["sets" + end], np.uint16)] for end in ("", "2")]
                (c, rc, n, _, pc, _), (d, rd, m, _, pd_, _) = sides
                maybe = _estimates(pc.reshape(-1, PLANES), pd_.reshape(-1, PLANES)) >= least
                maybe &= (rc[:, None] != rd[None]) & (100 * np.minimum(n[:, None], m[None]) >= link * np.maximum(n[:, None], m[None]))
                if not maybe.any():
                    continue
                rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
                common = _common(*[(lens, flat, chosen) for (_, _, _, lens, _, flat), chosen in zip(sides, (rows, cols))])
                n, m, ln, lm = n[rows], m[cols], sides[0][3][rows], sides[1][3][cols]
                # Shingles of one set that share a short hash count once there: at most so many are missed.
                common += np.minimum((n - ln)[:, None], (m - lm)[None])
                common = np.minimum(common, np.minimum(n[:, None], m[None]))
                fits = (100 * common >= link * (n[:, None] + m[None] - common)) & maybe[np.ix_(rows, cols)]
                for i, j in zip(*np.nonzero(fits)):
                    x, y = c[rows[i]].tobytes(), d[cols[j]].tobytes()
                    out.add((min(x, y), max(x, y)))
            yield pd.DataFrame(list(out), columns=["a", "b"])

    return compare


def _common(left: tuple, right: tuple) -> np.ndarray:
    """Sizes of the intersections of the chosen short sets of two blocks."""
    both, seen = np.zeros(65536, bool), np.zeros(65536, bool)
    both[left[1]] = True
    seen[right[1]] = True
    both &= seen
    column, width = np.cumsum(both) - 1, int(both.sum())
    matrices = []
    for lens, flat, chosen in (left, right):
        place = np.full(len(lens), -1)
        place[chosen] = np.arange(len(chosen))
        row = np.repeat(place, lens)
        keep = both[flat] & (row >= 0)
        x = np.zeros((len(chosen), width), np.float32)
        x[row[keep], column[flat[keep]]] = 1
        matrices.append(x)
    return (matrices[0] @ matrices[1].T).astype(np.int64)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", link: int = LINK) -> DataFrame:
    """id, n_shingles, component_id, kept of every row; `link` is the least similarity of a link in percent."""
    n_bands, n_rows, min_agree = layout(link)
    spark = df.sparkSession
    tune(spark)
    least = estimate(min_agree) - 1e-9
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    signed = docs.mapInPandas(_signatures(n_bands, n_rows), "id long, h long, cls binary, n long, bands array<long>, planes array<long>")
    signed, _ = written(signed, "signed")
    classes = signed.where("cls is not null").groupBy("cls").agg(
        F.min("id").alias("rep"), F.first(F.struct("id", "h")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("planes").alias("planes")
    )
    classes, _ = written(classes, "classes")

    # Bands of two classes or more, each with its pivot. A join by sorting is one whose large keys Spark splits.
    bands = classes.select("cls", F.explode("bands").alias("key"))
    pivots = bands.groupBy("key").agg(F.count("*").alias("size"), F.min_by("cls", F.xxhash64("key", "cls")).alias("pivot")).where("size > 1")
    pivots, _ = written(pivots, "pivots")
    shared, _ = written(bands.join(pivots.hint("merge"), "key"), "shared")
    sig = classes.select("cls", "n", "planes")

    def rated(pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate may reach the threshold."""
        a = sig.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("planes").alias("pa"))
        b = sig.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("planes").alias("pb"))
        out = pairs.join(a, "a").join(b, "b").withColumn("estimate", estimate(agree("pa", "pb")))
        return out.where(f"estimate >= {least!r} and 100 * least(na, nb) >= {link} * greatest(na, nb)").select("a", "b")

    # The texts of all classes in shared bands: of one row each, known by its id and its text's hash.
    need = shared.select("cls").distinct().join(classes.select("cls", F.col("one.id").alias("i"), F.col("one.h").alias("g")), "cls")
    texts = docs.join(need, (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i"))).groupBy("cls").agg(F.first("text").alias("text"))
    texts, texts_path = written(texts.mapInPandas(_short, "cls binary, text string, short binary"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
        return written(both.mapInPandas(_confirm(link), "a binary, b binary"), "links")[0]

    star = shared.where("cls <> pivot").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    star, _ = written(rated(star), "rated")
    links = confirmed(star)
    roots, _ = written(components(links, "a", "b"), "roots")

    # Bands of several components, but for those of two classes, whose one pair is done. The classes of a
    # band's largest component are its main ones; they needn't be compared with one another.
    rooted = shared.where("size > 2").join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    open_ = counts.agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("main_rows"), F.sum("n").alias("rows")).where("rows > main_rows")
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = open_.select("key", "top", blocks_of(F.col("main_rows")).alias("mains"), blocks_of(F.col("rows") - F.col("main_rows")).alias("others"))
    open_, _ = written(open_, "open")
    rows = rooted.join(open_.hint("merge"), "key").withColumn("main", (F.col("root") == F.col("top")).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.when(F.col("main") == 1, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    rows = rows.join(texts.select("cls", "short"), "cls").join(sig, "cls").select(*_HEAD, "cls", "root", "n", "planes", "short")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "main", "block").sortWithinPartitions("key", "main", "block")
    blocks = rows.mapInPandas(_packed, "key long, main int, block int, mains int, others int, " + ", ".join(f"{c} binary" for c in _BODY))
    blocks, blocks_path = written(blocks, "blocks")
    # Each block of other classes with those from itself on, and with all main ones.
    other = F.expr("transform(sequence(block, others - 1), x -> struct(0 as main, x as with))")
    main = F.expr("transform(sequence(0, mains - 1), x -> struct(1 as main, x as with))")
    left = blocks.where("main = 0").select("key", "block", *_BODY, F.explode(F.concat(other, main)).alias("p")).select("key", "block", *_BODY, "p.*")
    right = blocks.select("key", "main", F.col("block").alias("with"), *[F.col(c).alias(c + "2") for c in _BODY], F.explode(F.expr("if(main = 1, sequence(0, others - 1), sequence(0, block))")).alias("block"))
    met = left.join(right, ["key", "block", "main", "with"]).mapInPandas(_compared(link, least), "a binary, b binary").distinct()
    met, _ = written(met.join(star, ["a", "b"], "left_anti"), "met")
    drop(spark, blocks_path)
    links = links.unionByName(confirmed(met))
    drop(spark, texts_path)
    roots, _ = written(components(links, "a", "b"), "roots")

    whole = classes.select("cls", "rep").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "root").select("cls", "component_id")
    some = signed.where("cls is not null").select("id", "n", "cls").join(named, "cls").select("id", "n", "component_id")
    none = signed.where("cls is null").select("id", "n", F.col("id").alias("component_id"))
    return some.unionByName(none).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )

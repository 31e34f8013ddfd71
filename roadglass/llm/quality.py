"""Rule bitmask ledger: every rule is evaluated once, its failure is a bit, policies are masks over the bits.

The ledger keeps the measurements and the failure bits of every document. A policy is a named mask, so a
new version of a policy, or the question what a rule costs, needs no text and no second evaluation:
`apply_policy` is one bitwise AND, `ablation` a count by mask.

Null and empty texts have no words and fail the word-count rule; texts of any length are read whole; an empty table gives no
rows. Repeated rows and ids are judged on their
own. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import tune

#: The rules in the order of their bits, each with its failing condition over the measurements.
RULES = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 60 * m["n_lines"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    ("no_letters", lambda m: 100 * m["n_alpha_words"] < 70 * m["n_words"]),
)
#: The policies by version; the base rules, and all rules.
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": tuple(n for n, _ in RULES)}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ALPHA = re.compile(r"[A-Za-z\x80-\U0010FFFF][^\x20\x09-\x0D]*")
_SPACE = " \t\n\x0b\x0c\r"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * 7
    words = _WORD.findall(text)
    lines, seen, with_word, dups = text.split("\n"), set(), 0, 0
    if len(lines) > 1:
        for line in lines:
            if line.strip(_SPACE):
                with_word += 1
                if line in seen:
                    dups += 1
                else:
                    seen.add(line)
    else:
        with_word = 1 if words else 0
    repeats = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        counts, last = Counter(windows), 0
        for i, g in enumerate(windows):
            if counts[g] > 1:
                repeats += i + 3 - max(i, last)
                last = i + 3
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, "#*$%&|<>")),
        dups,
        repeats,
        with_word,
        len(_ALPHA.findall(text)),
    )


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in MEASURES]))
def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES))


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    bit = {n: 1 << k for k, (n, _) in enumerate(RULES)}
    return sum(bit[n] for n in POLICIES[policy])


def _bits(measures: Column) -> Column:
    """The failed rules' bits, from a struct of measurements."""
    total: Column = F.lit(0).cast("long")
    for k, (_, rule) in enumerate(RULES):
        total = total.bitwiseOR(F.when(rule(measures), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return total


def failed_bits(df: DataFrame, text: Column) -> Column:
    """The failed rules' bits of a text column of df."""
    tune(df.sparkSession)
    return _bits(_measured(text))


def ledger(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The columns `keep`, the measurements and failed_bits of every row of df."""
    tune(df.sparkSession)
    out = df.select(*[F.col(k) for k in keep], _measured(F.col(text)).alias("_measures"))
    return out.select(*keep, *[F.col("_measures")[n].alias(n) for n in MEASURES], _bits(F.col("_measures")).alias("failed_bits"))


def apply_policy(led: DataFrame, policy: str = "v1", column: str = "kept") -> DataFrame:
    """Adds whether a row passes every rule of the policy."""
    return led.withColumn(column, F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rows failing it, rows failing only it, and the rows kept without it."""
    m = mask(policy)
    by = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(n).alias("rule"), F.lit(1 << k).alias("bit")) for k, (n, _) in enumerate(RULES) if m >> k & 1]
    by = by.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return by.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("failed_only_here"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
    )

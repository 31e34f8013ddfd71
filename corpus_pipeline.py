"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), is written as Parquet to the shared folder and read again as the
next one's input. The first four return the columns of their input. Rows of one doc_id with equal texts
are one document; null and empty texts are rejected by the first stage; texts of any length are read whole;
an empty table gives no rows; extra columns are carried along, under whatever names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadglass.llm import neardedup, packing, pii, quality, toxicity
from roadglass.llm._common import fresh, settled, written

#: Near duplicates of the pipeline: similarity of five-word shingles in percent, at least.
NEAR_LINK = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the newest policy."""
    (failed,) = fresh(docs, "failed_bits")
    led = docs.withColumn(failed, quality.failed_bits(docs, F.col("text")))
    return led.where(F.col(failed).bitwiseAND(F.lit(quality.mask("v1"))) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5, by a model of the labelled ones among all of its input."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (value,) = fresh(docs, "toxicity")
    return toxicity.score(docs, model, "text", value).where(F.col(value) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: of least doc_id, null last.

    Rows, not ids, are compared and removed: a null or repeated doc_id says nothing of another row's text.
    Rows of one doc_id with equal texts are one document, even without words.
    """
    row, one, group, blank, id_, h, best, n = fresh(docs, "row", "one", "group", "blank", "id", "h", "best", "n")
    docs_by_row, _ = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = neardedup.near_duplicates(docs_by_row, row, link=NEAR_LINK)
    # Texts without words are in no component; they repeat only as equal texts of one id.
    found = found.select(F.col(row).alias(one), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias(group))
    rows = docs_by_row.select(row, F.col("doc_id").alias(id_), F.xxhash64("text").alias(h), F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).alias(blank))
    rows = rows.join(found, F.col(row) == F.col(one)).select(row, id_, h, group, *[F.when(F.col(group).isNull(), F.col(c)).alias(c + "0") for c in (id_, blank)])
    keys = [group, id_ + "0", blank + "0"]
    rows, _ = written(rows, "grouped")
    first = F.min(F.struct(F.col(id_).isNull().alias("null"), F.col(id_), F.col(h), F.col(row)))[row]
    many = rows.groupBy(*[F.col(k).alias(k + "1") for k in keys]).agg(first.alias(best), F.count("*").alias(n)).where(F.col(n) > 1)
    same = [F.col(k).eqNullSafe(F.col(k + "1")) for k in keys]
    lost, _ = written(rows.join(many, same).where(F.col(row) != F.col(best)).select(F.col(row).alias(one)), "lost")
    return docs_by_row.join(lost, F.col(row) == F.col(one), "left_anti").drop(row)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("pii", redact_pii),
    ("packing", pack),
]
#: SQL can express neither the trained stages nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


@settled
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents; each is written, what it wrote on the way goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settled(stage)(spark, docs, sf_dir)
    return docs

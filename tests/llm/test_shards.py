import zlib

from pyspark.sql import functions as F

from roadglass.llm import queries, shards


def brute(docs, n=8):
    """Rows in order of id with sizes; each to the shard in which its middle lies."""
    rows = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in docs))
    total, at, out, slots = sum(r[3] for r in rows), 0, [], [0] * n
    for known, i, crc, size in rows:
        k = min(n - 1, (2 * at + size) * n // (2 * total))
        out.append((i if known else None, size, crc, k, slots[k]))
        slots[k] += 1
        at += size
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[4]))


def test_as_brute_force(odd, odd_texts, sf_documents):
    assert rows(shards.shard(odd)) == sorted(brute(odd_texts), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[4]))
    docs = [(r["doc_id"], r["text"]) for r in sf_documents.collect()]
    assert rows(shards.shard(sf_documents)) == brute(docs)


def test_balance_and_slots(spark):
    """One id holds a third of all rows; sizes stay near equal and slots gapless."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"))
    got = shards.shard(df).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect()
    mean = sum(r["s"] for r in got) / 8
    assert len(got) == 8 and all(abs(r["s"] - mean) <= 101 and (r["a"], r["b"] + 1, r["d"]) == (0, r["n"], r["n"]) for r in got)


def test_empty_and_query(spark, empty, sf_documents):
    assert shards.shard(empty).count() == 0
    q = queries.QUERIES["op4_byte_shards"](spark, "/root/testdata/sf0.001")
    assert q.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and q.count() == sf_documents.count()
    assert "Python" not in q._jdf.queryExecution().toString()

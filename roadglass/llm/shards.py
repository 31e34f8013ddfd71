"""Global byte-size prefix sums from per-partition totals, cut at equal targets into contiguous shards.

The rows are dealt into ranges of their order (id, then checksum and size for equal ids), each range has
its total, the totals are summed up over the few ranges, and a row's place in the whole is its range's
place plus its place within. A row goes to the shard in which the middle of its bytes lies, so a shard
differs from its target by at most half a row at either end. Only narrow rows (no text) are shuffled, and
a salt over the place in the input parts any run of equal ids.

Law: bytes. Texts of any length count by their bytes alone. Null texts have no bytes and the checksum of no bytes (0). Null ids sort first. Repeated rows
get places of their own; an empty table gives no rows. Other columns are not looked at. Equal texts share
a checksum but not a shard: keeping a group that holds a third of all bytes together would break the law.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

N_SHARDS = 8
#: Rows of a range at most, as planned; ranges are as many as this needs, or as many as the session's partitions.
RANGE_ROWS = 2_000_000


def shard(df: DataFrame, id_col: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS) -> DataFrame:
    """id, size, text_crc32, shard, slot of every row."""
    spark = df.sparkSession
    narrow = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("crc"),
    ).withColumn("salt", F.monotonically_increasing_id())
    narrow, _ = written(narrow, "sizes")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), narrow.count() // RANGE_ROWS)
    order = ["id", "crc", "size", "salt"]
    ranged, _ = written(
        narrow.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).drop("salt").withColumn("at", F.monotonically_increasing_id()), "ranges"
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per range: the ranges are RANGE_ROWS rows each, so this side has a known bound.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy("id", "crc", "size", "at")
    placed = (
        ranged.select(
            "*",
            F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes_within"),
            F.row_number().over(within).alias("row_within"),
        )
        .join(F.broadcast(totals), "part")
        .select(
            "id",
            "size",
            "crc",
            # The middle of the row, doubled to stay whole: 2 * start + size.
            (2 * (F.col("bytes_before") + F.col("bytes_within")) - F.col("size")).alias("middle"),
            "all_bytes",
            (F.col("rows_before") + F.col("row_within") - 1).alias("row"),
        )
        .withColumn("shard", F.expr(f"cast(least({n_shards} - 1, (middle * {n_shards}) div (2 * all_bytes)) as int)"))
    )
    placed, _ = written(placed.select("id", "size", "crc", "shard", "row"), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).alias("slot")
    )

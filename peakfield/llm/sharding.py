"""Contiguous shards of near equal size, from global prefix sums of byte sizes.

Rows are range-partitioned by id, without their texts, and written; the totals of each part, one row for each, are summed up to
give every part's base, and a running sum inside the part does the rest, so no task sees more than its part. A row belongs to the
shard in which the middle of its bytes falls, so shard borders are within half a row of equal targets.

Cases: a null or empty text has size 1. Null ids sort first, repeated ids are ordered by size and checksum; fully equal rows take neighbouring
slots. An empty table gives no rows. With fewer rows than shards, or a very long row, some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import slim, written


def running(df: DataFrame, order: list[str], value: str, part: str = "part") -> DataFrame:
    """df, range-partitioned and written as parts, with `before`, the sum of value over all rows before, and `index`, their number."""
    totals = df.groupBy(part).agg(F.sum(value).alias("total"), F.count("*").alias("rows"))
    # as many rows as parts: one window over them is small at any size of input
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(part, F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("first"))
    inside = Window.partitionBy(part).orderBy(*order)
    rows = df.withColumn("before", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)).withColumn("index", F.row_number().over(inside) - 1)
    return rows.join(F.broadcast(bases), part).withColumn("before", F.col("before") + F.col("base")).withColumn("index", F.col("index") + F.col("first")).drop("base", "first")


def shards_by_bytes(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot (place inside the shard) for each row."""
    spark = df.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = slim(df, id=key, text=text).select("id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    order = ["id", "size", "text_crc32"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(own.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 1
    placed = running(rows, order, "size")
    shard = F.least(F.floor((F.col("before") * 2 + F.col("size")) * shards / F.lit(2 * total)), F.lit(shards - 1)).cast("int")
    placed = written(placed.withColumn("shard", shard), "placed")
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).cast("long").alias("slot"))

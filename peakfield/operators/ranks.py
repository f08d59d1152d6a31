"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so its lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def indexed(df: DataFrame, *order) -> DataFrame:
    """df with row_index, its place from 0 in the given order. Rows are range-partitioned and written; one total for each part is summed up to
    its base, and numbers inside the part do the rest, so no task sees more than its part."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranks")
    # one row for each part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn("row_index", inside).join(F.broadcast(bases), "_part").withColumn("row_index", F.col("row_index") + F.col("_base")).drop("_part", "_base")

"""Stacks of correlation maps: a table in shards of consecutive places, an index without values, and a commit file that is written last.

A stack has a fixed number of places and a fixed shape. Rows outside it, of another shape or on a place that is taken end the job before the commit, and
what has no commit is no stack. A range of places reads only its shards. A task that is lost writes its shard's file again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import committed, commit


def write_stack(rows: DataFrame, path: str, total: int, shape: tuple[int, int], per_shard: int = 256, place: str = "stack_index", values: str = "values") -> int:
    """Writes rows (place, values and any columns that describe them); how many there are. Places may stay empty."""
    size = shape[0] * shape[1]
    fits = F.col(place).between(0, total - 1) & F.col(place).isNotNull() & (F.size(values) == size)
    checked = F.when(fits, F.col(place)).otherwise(F.raise_error(F.format_string(f"place %s with %s values is outside a stack of {total} maps of {shape[0]} x {shape[1]}", F.col(place).cast("string"), F.size(values).cast("string"))).cast("long"))
    own = rows.withColumn(place, checked.cast("long")).withColumn(values, F.col(values).cast("array<float>")).withColumn("shard", F.floor(F.col(place) / per_shard).cast("int"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{path.rstrip('/')}/data"
    # a shard's rows meet in one task, which is bounded by the shard's size
    own.repartition(parts, "shard").sortWithinPartitions("shard", place).write.partitionBy("shard").parquet(folder)
    written = rows.sparkSession.read.parquet(folder)
    index = written.drop(values, "shard")
    twice = index.groupBy(place).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"place {twice[0][place]} stands in the stack more than once")
    index.write.parquet(f"{path.rstrip('/')}/index")
    n = index.count()
    commit(rows.sparkSession, path, {"total": total, "height": shape[0], "width": shape[1], "per_shard": per_shard, "written": n, "place": place})
    return n


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What describes the maps, without their values."""
    committed(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def read_stack(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Maps of an inclusive range of places; other shards are not read."""
    about = committed(spark, path)
    last = about["total"] - 1 if last is None else last
    if not 0 <= first <= last < about["total"]:
        raise ValueError(f"places {first} to {last} are outside a stack of {about['total']}")
    rows = spark.read.parquet(f"{path.rstrip('/')}/data").where(F.col("shard").between(first // about["per_shard"], last // about["per_shard"]))
    return rows.where(F.col(about["place"]).between(first, last)).drop("shard")

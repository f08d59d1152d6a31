"""Tables of a run: its tasks, its templates, what its shards left, and its timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import indexed


def tasks(pixels: DataFrame, defoci: DataFrame, orientations: DataFrame, n_defoci: int, n_orientations: int) -> DataFrame:
    """Every orientation (o) under every defocus (d) and pixel size (p), numbered with the pixel size outermost. The two tables of conditions are small, and
    their sizes are given, so they are paired first and sent to the orientations."""
    conditions = pixels.crossJoin(F.broadcast(defoci))
    return orientations.crossJoin(F.broadcast(conditions)).withColumn("task", (F.col("p") * n_defoci + F.col("d")) * n_orientations + F.col("o"))


def sliced(rows: DataFrame, index: str, first: int, last: int) -> DataFrame:
    """Rows of an inclusive range; a range that ends before it begins is an error."""
    if last < first:
        raise ValueError("an empty range was asked for")
    return rows.where(F.col(index).between(first, last))


def picked(rows: DataFrame, index: str, wanted: DataFrame) -> DataFrame:
    """Rows of listed numbers, for wanted (one column of the same name)."""
    return rows.join(wanted.select(index).distinct(), index, "left_semi")


def templates(jobs: DataFrame, key: list[str], order: str, output: str) -> DataFrame:
    """One row for each distinct key: the first job, how many share it, and whether one of its outputs is asked for by another key too."""
    own = jobs.groupBy(*key).agg(F.min(order).alias("first_job"), F.count("*").alias("jobs"))
    shared = jobs.select(*key, output).where(F.col(output).isNotNull()).distinct()
    clash = shared.groupBy(output).agg(F.count("*").alias("keys")).where("keys > 1").select(output)
    bad = shared.join(clash, output, "left_semi").select(*key).distinct().withColumn("conflict", F.lit(True))
    on = [own[k].eqNullSafe(bad[k]) for k in key]
    return own.join(bad, on, "left").select(*[own[k] for k in key], "first_job", "jobs", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def merged_stack(shards: DataFrame, task: str) -> DataFrame:
    """Records of all shards in the order of tasks, numbered anew; a task that stands twice is an error."""
    twice = shards.groupBy(task).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"task {twice[0][task]} stands in the shards more than once")
    return indexed(shards, F.col(task)).withColumnRenamed("row_index", "stack_index")


def sampled(batches: DataFrame, index: str, total: int, warm_up: int, every: int, most: int) -> DataFrame:
    """Every so manieth batch after the warm-up, spread so that at most so many are taken."""
    step = max(every, -(-max(total - warm_up, 1) // most), 1)
    return batches.where((F.col(index) >= warm_up) & ((F.col(index) - warm_up) % step == 0))


def recent_rate(points: DataFrame, by: str, at: Column, done: Column, *ties: str) -> DataFrame:
    """What has been done since the point before, by second; null at the first point and where no time has passed. at: microseconds, as
    whole numbers, since differences of seconds in a double are off by up to a quarter of a microsecond. Points of one time go by the columns of ties."""
    w = Window.partitionBy(by).orderBy("at", *ties)
    rows = points.withColumn("at", at).withColumn("done", done)
    return rows.withColumn("rate", F.try_divide(F.col("done") - F.lag("done").over(w), (F.col("at") - F.lag("at").over(w)) / 1e6))


def longest(rows: DataFrame, name: str, seconds: str, most: int) -> DataFrame:
    """The sections with the largest totals; ties go to the name that sorts first."""
    return rows.groupBy(name).agg(F.sum(seconds).alias("total"), F.count("*").alias("calls")).orderBy(F.desc("total"), name).limit(most)

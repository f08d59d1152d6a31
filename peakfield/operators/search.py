"""The core of a template search: scores of images against tasks, and their reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def templates(images: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """One template (task) for each group: the mean image, place by place."""
    places = images.select(group, F.posexplode(vector).alias("at", "v"))
    means = places.groupBy(group, "at").agg(F.avg("v").alias("v"))
    vectors = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("template"))
    return vectors.select(F.col(group).cast("long").alias("task"), "template")


def scores(images: DataFrame, tasks: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, task, score for every image and task: every place of the search is scored against every task. The task table is the search space and small;
    Spark broadcasts it below its own size limit, and else pairs partitions."""
    dot = F.aggregate(F.zip_with(F.col(vector), F.col("template"), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return images.select(key, vector).crossJoin(tasks).select(key, "task", F.round(dot, 9).alias("score"))


def maximum(found: DataFrame, key: str = "vec_id", initial: float = 0.0) -> DataFrame:
    """Best score and its task; equal scores go to the lower task; no task where nothing is above the initial value."""
    best = found.where(~F.isnan("score")).groupBy(key).agg(F.max(F.struct("score", (-F.col("task")).alias("t"))).alias("x"))
    won = F.col("x.score") > initial
    return best.select(key, F.when(won, F.col("x.score")).otherwise(initial).alias("mip"), F.when(won, -F.col("x.t")).alias("task"))


def moments(found: DataFrame, key: str = "vec_id") -> DataFrame:
    return found.groupBy(key).agg(F.sum("score").alias("s1"), F.sum(F.col("score") * F.col("score")).alias("s2"), F.count("*").alias("n"))


def merge_moments(*parts: DataFrame, key: str = "vec_id") -> DataFrame:
    """Moments of shards added up."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))


def merge_maxima(*parts: DataFrame, key: str = "vec_id") -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy(key).agg(F.max(F.struct(F.col("mip").alias("score"), (-F.col("task")).alias("t"))).alias("x"))
    return best.select(key, F.col("x.score").alias("mip"), (-F.col("x.t")).alias("task"))


COUNTED = 1e-4  # fixed value: least sum of squares of a counted place, and least local deviation
TINY = 1e-12


def reduced(found: DataFrame, key: str = "vec_id", initial: float = 0.0) -> DataFrame:
    """Maximum, its task and the moments of each key from one aggregation."""
    best = F.max(F.when(~F.isnan("score"), F.struct("score", (-F.col("task")).alias("t")))).alias("x")
    rows = found.groupBy(key).agg(best, F.sum("score").alias("s1"), F.sum(F.col("score") * F.col("score")).alias("s2"), F.count("*").alias("n"))
    won = F.coalesce(F.col("x.score") > initial, F.lit(False))
    return rows.select(key, F.when(won, F.col("x.score")).otherwise(initial).alias("mip"), F.when(won, -F.col("x.t")).alias("task"), "s1", "s2", "n")


def merged(*parts: DataFrame, key: str = "vec_id") -> DataFrame:
    """What reduced gives of each shard as one: shards without a winner leave the others' in place, equal maxima go to the lower task."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.max(F.struct(F.col("mip").alias("score"), (-F.col("task")).alias("t"))).alias("x")
    rows = every.groupBy(key).agg(best, F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))
    return rows.select(key, F.col("x.score").alias("mip"), (-F.col("x.t")).alias("task"), "s1", "s2", "n")


def global_scale(m: DataFrame, valid: Column | None = None) -> DataFrame:
    """Mean and deviation over all counted places (of those that are valid): one row. No counted place at all is an error."""
    counted = m.where(F.col("s2") > COUNTED)
    counted = counted if valid is None else counted.where(valid)
    one = counted.agg(F.count("*").alias("counted"), (F.sum("s1") / F.sum("n")).alias("mean"), (F.sum("s2") / F.sum("n")).alias("square"))
    none = F.raise_error(F.lit("no place is counted")).cast("double")
    return one.select("counted", F.when(F.col("counted") > 0, F.col("mean")).otherwise(none).alias("mean"), F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(TINY))).alias("std"))


def scaled_maps(found: DataFrame, key: str = "vec_id", valid: Column | None = None, flatten: bool = True) -> DataFrame:
    """The maps of a search (mip, s1, s2, n) on the scale of its counted, valid places: z of the maximum, mean and deviation of each place, its sums, and the maximum
    scaled by the place's own mean and deviation where that is usable. Outside the counted places all but z and scaled are zero. flatten: false leaves scaled at z."""
    g = global_scale(found, valid).select(F.col("mean").alias("gm"), F.col("std").alias("gs"))
    counted = F.coalesce((F.col("s2") > COUNTED) & (F.lit(True) if valid is None else valid), F.lit(False))
    inside = lambda c: F.when(F.col("counted"), c).otherwise(0.0)
    sums = (F.col("s1") - F.col("n") * F.col("gm")) / F.col("gs")
    squares = (F.col("s2") - 2 * F.col("gm") * F.col("s1") + F.col("n") * F.col("gm") * F.col("gm")) / (F.col("gs") * F.col("gs"))
    rows = found.withColumn("counted", counted).crossJoin(F.broadcast(g))
    rows = rows.select(key, "counted", "n", ((F.col("mip") - F.col("gm")) / F.col("gs")).alias("z"), inside(sums).alias("sum"), inside(squares).alias("squares"))
    rows = rows.withColumn("local_mean", F.col("sum") / F.col("n"))
    rows = rows.withColumn("local_std", F.sqrt(F.greatest(F.col("squares") / F.col("n") - F.col("local_mean") * F.col("local_mean"), F.lit(0.0))))
    usable = F.col("counted") & (F.col("local_std") > COUNTED) & F.lit(flatten)
    return rows.select(key, "z", "local_mean", "local_std", "sum", "squares", F.when(usable, (F.col("z") - F.col("local_mean")) / F.col("local_std")).otherwise(F.col("z")).alias("scaled"))


def flat_field(best: DataFrame, m: DataFrame, key: str = "vec_id") -> DataFrame:
    """The same from maxima and moments that stand apart."""
    return scaled_maps(best.join(m, key), key)


def decode(tasks: DataFrame, orientations: int, defoci: int, column: str = "task") -> DataFrame:
    """Orientation, defocus and pixel-size index of a task number; null has none."""
    t = F.col(column)
    c = F.expr(f"{column} div {orientations}")
    return tasks.withColumns({"orientation": t % orientations, "defocus": c % defoci, "pixel": F.expr(f"({column} div {orientations}) div {defoci}")})

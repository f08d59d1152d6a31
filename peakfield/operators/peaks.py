"""Peak picking: greedy selection with suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import indexed, written

#: Rows that a task sorts at a time.
PART_ROWS = 250_000


def greedy(df: DataFrame, threshold: float, radius: float, most: int) -> DataFrame:
    """df: grid, x, y, score. Per grid the best score, then the best outside its disc, and so on; equal scores go by y, then x. Only places that reach the
    threshold leave the scan; NaN and infinity never do, nor a place without x or y.

    A point is chosen by the greedy rule just if it is the best of the undecided in its disc; it then decides all in its disc, and the next round goes on with the
    rest. So a grid of any size spreads over its tiles. Every round is written; their number is the longest chain of falling neighbours that
    decide each other, for scores without order about the logarithm of the number of points."""
    good = df.where(F.col("score").isNotNull() & (F.abs("score") < float("inf")) & (F.col("score") >= threshold) & F.col("x").isNotNull() & F.col("y").isNotNull())
    # of a place only the best score can be chosen, whatever the radius
    left = good.select("grid", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("score").cast("double").alias("score")).groupBy("grid", "x", "y").agg(F.max("score").alias("score"))
    if radius < 1:
        return _ranked(left, most)
    # tiles of the radius: a disc lies in nine of them; cells in which any two points are in each other's disc
    tile = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    cell = lambda c: F.floor(F.col(c) / F.lit(radius / 2**0.5))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = lambda rows: rows.withColumn("o", F.explode(around)).select("grid", "x", "y", "score", (tile("x") + F.col("o.i")).alias("tx"), (tile("y") + F.col("o.j")).alias("ty"))
    near = f"a.grid <=> b.grid and a.tx = b.tx and a.ty = b.ty and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {float(radius) ** 2!r}D"
    left = written(left.withColumn("tx", tile("x")).withColumn("ty", tile("y")), "undecided")
    rounds, parts = [], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while size := left.count():
        best = F.max(F.struct("score", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("best")
        # the best of a cell is found by sorting, so rows are dealt to as many tasks as keep each sort small
        dealt = left.withColumn("cx", cell("x")).withColumn("cy", cell("y")).repartition(max(parts, -(-size // PART_ROWS)), "grid", "cx", "cy")
        hopeful = dealt.groupBy("grid", "cx", "cy").agg(best).select("grid", (-F.col("best.x")).alias("x"), (-F.col("best.y")).alias("y"), "best.score")
        better = f"{near} and (b.score > a.score or b.score = a.score and (b.y < a.y or b.y = a.y and b.x < a.x))"
        beaten = spread(hopeful).alias("a").join(left.alias("b"), F.expr(better)).select("a.grid", "a.x", "a.y").distinct()
        same = lambda u, v: F.expr(f"{u}.grid <=> {v}.grid and {u}.x = {v}.x and {u}.y = {v}.y")
        chosen = written(hopeful.alias("a").join(beaten.alias("b"), same("a", "b"), "left_anti"), "chosen")
        rounds.append(chosen)
        left = written(left.alias("a").join(spread(chosen).alias("b"), F.expr(near), "left_anti"), "undecided")
    return _ranked(reduce(DataFrame.union, rounds, left.select("grid", "x", "y", "score")), most)


def _ranked(chosen: DataFrame, most: int) -> DataFrame:
    """The first most of each grid with their rank."""
    rows = written(indexed(chosen, F.asc("grid"), F.desc("score"), F.asc("y"), F.asc("x")), "ranked")
    first = rows.groupBy(F.col("grid").alias("own")).agg(F.min("row_index").alias("first"))
    ranked = rows.join(first, F.col("grid").eqNullSafe(F.col("own"))).withColumn("rank", F.col("row_index") - F.col("first") + 1)
    return ranked.where(F.col("rank") <= most).select("grid", F.col("rank").cast("int").alias("rank"), "x", "y", "score")


def top(df: DataFrame, threshold: float, most: int, score: str, *tie: str) -> DataFrame:
    """Without a radius: the highest scores at or above the threshold, with their rank; a top-k report."""
    from pyspark.sql.window import Window

    best = df.where(F.col(score) >= threshold).orderBy(F.desc(score), *tie).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *tie)))


#: What a peak's file says of the place of each peak, besides its rank, place and score.
LABELS = ("mip_zscore", "phi_deg", "theta_deg", "psi_deg", "defocus_offset_angstrom", "pixel_size_offset_angstrom")


def described(peaks: DataFrame, maps: DataFrame, pixel: float, grid: str = "grid") -> DataFrame:
    """The twelve columns of a file of peaks, and the grid: peaks (grid, rank, x, y, score) with the values that maps (grid, x, y and LABELS) have there. A peak
    outside the maps has none of them."""
    on = [peaks[c].eqNullSafe(maps[c]) for c in (grid, "x", "y")]
    rows = peaks.join(maps, on, "left")
    return rows.select(peaks[grid], peaks["rank"], peaks["x"].alias("x_pixel"), peaks["y"].alias("y_pixel"), (peaks["x"] * F.lit(float(pixel))).alias("x_angstrom"), (peaks["y"] * F.lit(float(pixel))).alias("y_angstrom"), peaks["score"], *[maps[c] for c in LABELS])

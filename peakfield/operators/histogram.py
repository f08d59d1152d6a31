"""The score histogram and its curves: 512 half-open bins over [-12.5, 22.5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import normal

#: Fixed values of the histogram.
BINS, LOW, STEP = 512, -12.5, 35.0 / 512


def bin_of(v: Column) -> Column:
    return F.floor((v - LOW) / STEP).cast("int")


def histogram(df: DataFrame, value: str) -> DataFrame:
    """bin, n of values inside the range; the upper end, null and NaN count nowhere."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(bin_of(F.col(value)).alias("bin"))
    return rows.where(f"bin between 0 and {BINS - 1}").groupBy("bin").agg(F.count("*").alias("n"))


def sampled(df: DataFrame, value: str, task: str, every: int) -> DataFrame:
    """Every so many tasks, each counted with one weight over all tasks, so totals do not depend on batches."""
    one = df.agg(F.count("*").alias("all"), F.count_if(F.col(task) % every == 0).alias("some"))
    return histogram(df.where(F.col(task) % every == 0), value).crossJoin(F.broadcast(one)).select("bin", (F.col("n") * F.col("all") / F.col("some")).alias("n"))


def dense(counts: DataFrame) -> DataFrame:
    """All bins; the table has 512 rows at any size of input."""
    return counts.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def survival(counts: DataFrame) -> DataFrame:
    """How many values are in a bin or above."""
    w = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return dense(counts).select("bin", "n", F.sum("n").over(w).alias("survival"))


def smoothed(counts: DataFrame) -> DataFrame:
    """Savitzky-Golay of five points and degree three, edges replicated, not below 0, rounded half to even."""
    w = Window.orderBy("bin")
    n = F.col("n")
    at = lambda k: F.coalesce(F.lead("n", k).over(w) if k > 0 else F.lag("n", -k).over(w), F.col("edge_hi") if k > 0 else F.col("edge_lo"))
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = dense(counts).withColumn("edge_lo", F.first("n").over(whole)).withColumn("edge_hi", F.last("n").over(whole))
    v = (-3 * at(-2) + 12 * at(-1) + 17 * n + 12 * at(1) - 3 * at(2)) / 35.0
    return rows.select("bin", "n", F.rint(F.greatest(v, F.lit(0.0))).cast("long").alias("smooth"))


def report(counts: DataFrame, trials: Column, mean: float = 0.0, deviation: float = 1.0) -> DataFrame:
    """The seven columns of a histogram's file: bin, midpoint, midpoint scaled by the global mean and deviation, raw and smoothed count, how many smoothed ones are in
    a bin or above, and how many of so many trials noise alone would have above the midpoint."""
    above = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # 512 rows
    middle = F.col("bin") * STEP + (LOW + STEP / 2)
    return smoothed(counts).select("bin", middle.alias("snr_midpoint"), ((middle - mean) / deviation).alias("source_curve_x_scaled"), F.col("n").alias("raw_count"), F.col("smooth").alias("smoothed_count"), F.sum("smooth").over(above).alias("observed_survival"), (normal.survival(middle) * trials).alias("expected_gaussian_survival"))

"""Masks, fills and statistics of result maps in long form, and weights over frequencies, all as columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import written


def cosine_edge(at: Column, centre: float, radius: float, edge: float = 7.0) -> Column:
    """1 within a radius, falling to 0 over an edge by a raised cosine."""
    inner = max(radius - 0.5 * edge, 0.0)
    d = F.abs(at - F.lit(float(centre)))
    return F.when(d <= inner, 1.0).when(d < inner + edge, (1 + F.cos((d - inner) * (math.pi / edge))) * 0.5).otherwise(0.0)


def cosine_mask(y: Column, x: Column, centre: tuple[float, float], radius: tuple[float, float], least: float = 0.9) -> Column:
    """Whether a place is inside the rectangle whose soft edges are cut at least."""
    return cosine_edge(y, centre[0], radius[0]) * cosine_edge(x, centre[1], radius[1]) >= least


def nearest_offsets(radius: int) -> list[tuple[int, int, int, int]]:
    """(distance squared, order, dy, dx): the own row from left to right, then rows above and below, further and further off."""
    places = [(0, dx) for dx in range(-radius, radius + 1) if dx] + [(s * k, dx) for k in range(1, radius + 1) for s in (-1, 1) for dx in range(-radius, radius + 1)]
    return [(dy * dy + dx * dx, i, dy, dx) for i, (dy, dx) in enumerate(places)]


def nearest_fill(px: DataFrame, radius: int, key: str = "vec_id") -> DataFrame:
    """Places without a value (v null) take that of the nearest place that has one, within a radius along each axis; other places keep their own.
    Known values go out to the places around them, and each place picks by distance, then order."""
    spots = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for d, i, dy, dx in nearest_offsets(radius)])
    sent = px.where("v is not null").select(key, "y", "x", "v", F.explode(spots).alias("o"))
    best = sent.groupBy(key, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x")).agg(F.min_by("v", F.struct("o.d", "o.i")).alias("near"))
    return px.join(best, [key, "y", "x"], "left").select(key, "y", "x", F.coalesce("v", "near").alias("v"))


def flooded(px: DataFrame, key: str = "vec_id") -> DataFrame:
    """Places without a value (v null) take that of a neighbour (left, right, above, below, in this order), round by round, from what was known before the
    round. Only places that were filled last send on their value, and every round is written. A map without any value stays as it is. Joins are merged, not
    broadcast, as each of many rounds would else send its front through the driver."""
    ways = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate([(0, 1), (0, -1), (1, 0), (-1, 0)])])
    place = [key, "y", "x"]
    front, found = px.where("v is not null").select(*place, "v"), []
    missing = px.where("v is null").select(*place)
    while True:
        sent = front.select(key, "y", "x", "v", F.explode(ways).alias("o")).select(key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "v", "o.i")
        front = written(sent.join(missing.hint("merge"), place, "left_semi").groupBy(*place).agg(F.min_by("v", "i").alias("v")), "filled")
        if not front.limit(1).count():
            break
        found.append(front)
        missing = written(missing.join(front.hint("merge"), place, "left_anti"), "missing")
    near = reduce(DataFrame.union, found, front).withColumnRenamed("v", "near")
    return px.join(near.hint("merge"), place, "left").select(*place, F.coalesce("v", "near").alias("v"))


def scattered(px: DataFrame, factor: float, centre: int, target: int, size: int, key: str = "vec_id") -> DataFrame:
    """Labels of a binned map at their places in the original grid; a place outside it is an error. Of several labels of one place the one from the
    last place in row order stays."""
    to = lambda c: ((F.col(c) - centre) * F.lit(float(factor))).cast("int") + target
    ok = to("y").between(0, size - 1) & to("x").between(0, size - 1)
    rows = px.select(key, F.when(ok, to("y")).otherwise(F.raise_error(F.lit("a label falls outside the grid")).cast("int")).alias("ty"), to("x").alias("tx"), "y", "x", "v")
    return rows.groupBy(key, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.max_by("v", F.struct(rows["y"], rows["x"])).alias("v"))


def two_masks(px: DataFrame, moments: Column, counts: Column, key: str = "vec_id") -> DataFrame:
    """Moments over one rectangle and counts over another, in one pass."""
    return px.groupBy(key).agg(F.sum(F.when(moments, F.col("v"))).alias("s1"), F.sum(F.when(moments, F.col("v") * F.col("v"))).alias("s2"), F.count_if(counts).alias("counted"), F.count_if(counts & (F.col("v") > 0)).alias("above"))


def projection_statistics(px: DataFrame, side: int, target: int, radius: float, l1_target: float, key: str = "vec_id") -> DataFrame:
    """Mean inside a centred circle; variance in the target box after the edge mean is taken off; the exponent of two that brings the sum of sizes to l1_target."""
    c, rho = (side - 1) / 2.0, side * side / (target * target)
    inside = (F.col("y") - c) * (F.col("y") - c) + (F.col("x") - c) * (F.col("x") - c) <= radius * radius
    border = F.col("y").isin(0, side - 1) | F.col("x").isin(0, side - 1)
    one = px.groupBy(key).agg(F.avg(F.when(inside, F.col("v"))).alias("circle"), F.avg(F.when(border, F.col("v"))).alias("edge"), F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("square"), F.sum(F.abs("v")).alias("l1"))
    mean = F.col("mean") - F.col("edge")
    square = F.col("square") - 2 * F.col("edge") * F.col("mean") + F.col("edge") * F.col("edge")
    exponent = F.greatest(F.lit(-60.0), F.least(F.lit(0.0), F.floor(F.log2(F.lit(l1_target) / F.greatest("l1", F.lit(1e-12)))).cast("double")))
    return one.select(key, F.coalesce("circle", "mean").alias("circle_mean"), F.greatest(square * rho - (mean * rho) * (mean * rho), F.lit(1e-12)).alias("variance"), exponent.alias("exponent"))


def health(df: DataFrame, value: str) -> DataFrame:
    """Whether all values are finite and any is not zero, and what they are."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    one = df.agg(F.count_if(finite).alias("finite_count"), F.count("*").alias("total_count"), F.coalesce(F.sum(F.when(finite, F.abs(v))), F.lit(0.0)).alias("absolute_sum"), F.coalesce(F.max(F.when(finite, F.abs(v))), F.lit(0.0)).alias("maximum_absolute"))
    return one.select(((F.col("finite_count") == F.col("total_count")) & (F.col("absolute_sum") > 0)).alias("healthy"), "*", (F.col("total_count") - F.col("finite_count")).alias("nonfinite_count"))


def bandpass(ring: Column, low: float, high: float, edge: float) -> Column:
    """1 from the low to the high cut, with half cosines beside them that end at a half."""
    up, down = 0.5 * F.cos((ring - high) * (math.pi / (2 * edge))) + 0.5, 0.5 * F.cos((F.lit(low) - ring) * (math.pi / (2 * edge))) + 0.5
    return F.when((ring >= low) & (ring < high), 1.0).when((ring >= high) & (ring < high + edge), up).when((ring >= low - edge) & (ring < low) & (ring >= 0), down).otherwise(0.0)


def template_bandpass(ring: Column, high: float, edge: float) -> Column:
    """1 below the high cut, with a half cosine after it."""
    return F.when((ring >= 0) & (ring < high), 1.0).when((ring >= high) & (ring < high + edge), 0.5 * F.cos((ring - high) * (math.pi / (2 * edge))) + 0.5).otherwise(0.0)


def noise_ratio(s: Column, curve: tuple[float, float, float]) -> Column:
    """Noise to signal at a spatial frequency, from the differences of two quadratics' coefficients."""
    return F.exp(F.greatest(F.lit(-80.0), F.least(F.lit(80.0), s * s * curve[0] + s * curve[1] + F.lit(curve[2]))))


def frequency_weights(ctf: Column, s: Column, curve: tuple[float, float, float], kk: float, epsilon: float = 1e-12) -> tuple[Column, Column]:
    """Weights of an image, damped above a sixth, and of a projection, which keeps the sign of the transfer function."""
    ratio, c2 = noise_ratio(s, curve), ctf * ctf
    below = F.greatest(ratio * (kk + 1.0) + c2 * kk, F.lit(epsilon))
    return F.sqrt(F.greatest(c2 + ratio, F.lit(0.0)) / below) * F.when(s > 1 / 6, F.exp(s * s * -100.0)).otherwise(1.0), ctf / F.sqrt(below)

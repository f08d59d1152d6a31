"""Orientation grids, rotation matrices and search offsets.

A grid's size depends on its steps alone, not on the data, so the driver makes the views and Spark crosses them with the in-plane
angles. Angles accumulate in single precision, as the number of views depends on it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

f32 = np.float32
#: Largest phi (before division by the order) and theta of each family of symmetries, in degrees.
RANGES = {"C": (360.0, 180.0), "D": (360.0, 90.0), "T": (180.0, 54.7), "O": (90.0, 54.7), "I": (180.0, 31.7)}


def ranges(symmetry: str, whole: bool = True) -> tuple[np.float32, np.float32]:
    """Largest phi and theta; whole: cyclic symmetries go on to the lower half, as an image and its mirror differ."""
    found = re.fullmatch(r"([CD])\s*([1-9]\d*)|([TOI])", symmetry.strip().upper())
    if not found:
        raise ValueError(f"no such symmetry: {symmetry}")
    phi, theta = RANGES[found[1] or found[3]]
    theta = 90.0 if found[1] == "C" and not whole else theta
    return f32(phi) / f32(found[2] or 1), f32(theta)


def steps(step: np.float32, stop: np.float32, closed: bool = False) -> np.ndarray:
    """0, step, 2 step ... up to stop, each the single-precision sum of the one before and the step."""
    n = int(stop / step) + 3
    all_steps = np.add.accumulate(np.concatenate([[f32(0)], np.full(n, step, f32)]), dtype=f32)
    return all_steps[all_steps <= stop] if closed else all_steps[all_steps < stop]


def circles(symmetry: str, angular_step: float, whole: bool = True) -> Iterator[tuple[np.float32, np.ndarray]]:
    """theta in equal steps, and the phis of each circle, in steps of about equal length."""
    phi_max, theta_max = ranges(symmetry, whole)
    step = f32(angular_step)
    n = int(theta_max / step + f32(0.5)) if step > 0 else 0
    if n < 1:
        raise ValueError("the angular step gives no views")
    theta_step = theta_max / f32(n)
    for theta in steps(theta_step, theta_max + theta_step / f32(2)):
        around = phi_max
        if theta not in (f32(0), f32(180)):
            wide = min(abs(step / np.sin(theta * f32(math.pi / 180))), phi_max)
            around = phi_max / f32(max(1, int(phi_max / wide + f32(0.5))))
        yield theta, steps(around, phi_max)


def views(symmetry: str, angular_step: float, whole: bool = True) -> list[tuple[float, float]]:
    """(phi, theta) of all views."""
    return [(float(phi), float(theta)) for theta, around in circles(symmetry, angular_step, whole) for phi in around]


def orientations(spark: SparkSession, symmetry: str, angular_step: float, psi_step: float, keep_360: bool = True) -> DataFrame:
    """orientation_index, grid_index, phi, theta, psi; psi runs fastest."""
    psi = [float(x) for x in steps(f32(psi_step), f32(360), closed=True)]
    if not keep_360 and abs(psi[-1] - 360) <= 1e-4:
        psi.pop()
    grid = spark.createDataFrame([(i, *v) for i, v in enumerate(views(symmetry, angular_step))], "grid_index long, phi double, theta double")
    inner = F.posexplode(F.array(*[F.lit(x) for x in psi])).alias("psi_index", "psi")
    return grid.select("*", inner).select((F.col("grid_index") * len(psi) + F.col("psi_index")).alias("orientation_index"), "grid_index", "phi", "theta", "psi")


def single(value: Column | float) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def angular_step(resolution: Column, radius: Column) -> Column:
    """Step in degrees that a resolution asks for at a radius, in single precision."""
    return single(180 / math.pi) * single(2.0 * single(resolution) / single(radius))


def psi_step(pixel: Column, radius: Column) -> Column:
    """A whole part of the circle, of about one pixel at the radius, in single precision."""
    arc = single(180 / math.pi) * single(single(pixel) / single(radius))
    return F.when(arc.isNotNull(), single(360.0 / F.greatest(F.lit(1), F.floor(single(360.0 / arc) + single(0.5)))))


@lru_cache(4096)
def view_count(symmetry: str | None, step: float | None, whole: bool) -> int | None:
    """How many views a grid has; null where there is no such grid."""
    try:
        return sum(len(around) for _, around in circles(symmetry, step, whole))
    except (ValueError, TypeError, AttributeError):
        return None


def planned(rows: DataFrame, whole: bool = True) -> DataFrame:
    """rows (symmetry, resolution, pixel, radius, angular_step, psi_step, one: whether a single view is asked for) with the grid that a search takes: radius_used,
    angular_used, psi_used (in degrees), n_views, n_psi and n_orientations. A radius below 1 is 200; a step that is null or not positive follows from
    resolution and pixel. What cannot be made (no such symmetry, no steps) has null counts."""
    asked = lambda c: F.col(c).isNotNull() & (F.col(c) > 0)
    one = F.coalesce(F.col("one"), F.lit(False))
    # a single view keeps any radius that is given
    given = F.coalesce(F.when(one, F.col("radius") != 0).otherwise(F.col("radius") >= 1), F.lit(False))
    rows = rows.withColumn("radius_used", F.when(given, F.col("radius").cast("double")).otherwise(200.0))
    able = lambda c: F.when((F.col(c) > 0) & (F.col("radius_used") > 0), F.col(c))
    step = F.when(asked("angular_step"), F.col("angular_step").cast("double")).otherwise(angular_step(able("resolution"), F.col("radius_used")).cast("double"))
    turn = F.when(asked("psi_step"), F.col("psi_step").cast("double")).otherwise(psi_step(able("pixel"), F.col("radius_used")).cast("double"))
    rows = rows.withColumns({"angular_used": F.when(one, 0.0).otherwise(step), "psi_used": F.when(one, 0.0).otherwise(turn)})

    @F.pandas_udf("long")
    def around(symmetry: pd.Series, step: pd.Series) -> pd.Series:
        return pd.Series([view_count(a, None if pd.isna(b) else b, whole) for a, b in zip(symmetry, step, strict=True)], dtype="Int64")

    @F.pandas_udf("long")
    def turns(step: pd.Series) -> pd.Series:
        known = {b: len(steps(f32(b), f32(360), closed=True)) for b in step.dropna().unique() if f32(b) > 0}
        return step.map(known).astype("Int64")

    rows = rows.withColumns({"n_views": F.when(one, F.lit(1).cast("long")).otherwise(around("symmetry", "angular_used")), "n_psi": F.when(one, F.lit(1).cast("long")).otherwise(turns("psi_used"))})
    return rows.withColumn("n_orientations", F.col("n_views") * F.col("n_psi"))


def rotation(phi: Column, theta: Column, psi: Column) -> Column:
    """The rotation about z, the new y and the new z by Euler angles in degrees: an array of the nine entries, row by row."""
    (a, sa), (b, sb), (c, sc) = ((F.cos(F.radians(x)), F.sin(F.radians(x))) for x in (phi, theta, psi))
    return F.array(a * b * c - sa * sc, -a * b * sc - sa * c, sb * a, sa * b * c + a * sc, -sa * b * sc + a * c, sb * sa, -sb * c, sb * sc, b)


def offsets(extent: Column, step: Column) -> Column:
    """Offsets -h step ... h step that an extent to both sides allows; without extent or step only 0."""
    h = F.floor(extent / step + 0.5).cast("long")
    return F.when((extent > 0) & (step > 0), F.transform(F.sequence(-h, h), lambda i: i * step)).otherwise(F.array(F.lit(0.0)))

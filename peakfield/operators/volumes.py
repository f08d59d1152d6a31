"""Volumes held as flat arrays: means, central slices of their spectra, and the projections that slices give.

A volume and the views it is cut by are one row each; pairs are cut by numpy inside Arrow batches, so nothing is shuffled, and a task holds one
batch. A volume's origin is its middle, and so is a projection's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spectral

TINY = 1e-12


def sphere_mean(volumes: DataFrame, side: int, radius: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Mean inside a centred sphere; of the whole volume where the sphere holds no voxel. Each volume is read in its own array."""
    c = (side - 1) / 2.0
    off = lambda at: (at - c) * (at - c)
    inside = F.filter(F.sequence(F.lit(0), F.lit(side**3 - 1)), lambda i: off(F.floor(i / side**2)) + off(F.floor(i / side) % side) + off(i % side) <= radius * radius)
    # the places are the same for all volumes: one array, made once
    own = volumes.select(key, vector).crossJoin(F.broadcast(volumes.sparkSession.range(1).select(inside.alias("inside"))))
    own = own.withColumn("inside", F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.sequence(F.lit(0), F.lit(side**3 - 1))))
    total = F.aggregate("inside", F.lit(0.0), lambda a, i: a + F.get(F.col(vector), i.cast("int")).cast("double"))
    return own.select(key, (total / F.size("inside")).alias("mean"))


def rotations(phi: np.ndarray, theta: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """(views, 3, 3) of angles in degrees: about z by psi, about y by theta, about z by phi."""

    def about(axis: int, degrees: np.ndarray) -> np.ndarray:
        c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        out = np.zeros((len(degrees), 3, 3))
        a, b = [i for i in range(3) if i != axis]
        out[:, axis, axis] = 1
        out[:, a, a], out[:, b, b] = c, c
        # from z to x where the axis is y
        out[:, a, b], out[:, b, a] = (s, -s) if axis == 1 else (-s, s)
        return out

    return about(2, np.asarray(phi, float)) @ about(1, np.asarray(theta, float)) @ about(2, np.asarray(psi, float))


def spectrum(volume: np.ndarray) -> np.ndarray:
    """The whole spectrum of a cube about its middle, axes (z, y, x)."""
    return np.fft.fftn(np.fft.ifftshift(volume), norm="forward")


def cut(full: np.ndarray, turns: np.ndarray, size: int, scale: float = 1.0) -> np.ndarray:
    """(views, size, size // 2 + 1): the spectrum on planes through its origin, trilinear between its samples. Beyond them, and at the origin, it is zero;
    on the line x = 0 a frequency and its negative are conjugates."""
    n = len(full)
    fy, fx = np.meshgrid(np.fft.fftfreq(size, 1 / size), np.arange(size // 2 + 1.0), indexing="ij")
    x, y, z = np.moveaxis(np.einsum("vij,jhw->vihw", turns[:, :, :2], np.stack([fx, fy])) * (scale * n / size), 1, 0)
    low = [np.floor(v).astype(int) for v in (z, y, x)]
    most, least = (n - 1) // 2, -(n // 2)
    i = low[2]
    inside = np.where(x < 0, i >= -(n // 2), i + 1 <= n // 2)
    for v in low[:2]:
        inside &= (v >= least) & (v + 1 <= most)
    out = np.zeros(x.shape, complex)
    for corner in np.ndindex(2, 2, 2):
        at = [lo + d for lo, d in zip(low, corner, strict=True)]
        weight = np.prod([1 - np.abs(v - a) for v, a in zip((z, y, x), at, strict=True)], axis=0)
        # a real volume's spectrum is periodic, so negative places need no conjugates
        out += full[tuple(a % n for a in at)] * weight
    out[~inside] = 0
    out[:, 0, 0] = 0
    k = np.arange(1, (size - 1) // 2 + 1)
    out[:, size - k, 0] = np.conj(out[:, k, 0])
    return out


def projected(slices: np.ndarray, rho: float = 1.0) -> np.ndarray:
    """Real projections about their middle: edge mean taken off, and divided by the deviation in a box of 1 / rho times their area."""
    size = slices.shape[1]
    v = np.fft.fftshift(np.fft.irfft2(slices, s=(size, size), norm="forward"), axes=(1, 2))
    border = np.ones((size, size), bool)
    border[1:-1, 1:-1] = False
    v = v - v[:, border].mean(1)[:, None, None]
    variance = (v * v).mean((1, 2)) * rho - (v.mean((1, 2)) * rho) ** 2
    return v / np.sqrt(np.maximum(variance, TINY))[:, None, None]


def self_whitened(slices: np.ndarray, epsilon: float = 1e-12) -> np.ndarray:
    """Every slice over the root of its own mean power in rings one sample wide, whose first is around one. The stored half counts once; what lies in no ring (the
    origin, and corners) becomes zero. A ring of less power than epsilon is taken to have that."""
    n = slices.shape[1]
    count, y = max(n // 2, 1), np.minimum(np.arange(n), n - np.arange(n))
    ring = np.floor(np.hypot(y[:, None], np.arange(n // 2 + 1)) + 0.5).astype(int) - 1
    held = (ring >= 0) & (ring < count)
    at = ring[held]
    power = np.stack([np.bincount(at, p, count) for p in np.abs(slices[:, held]) ** 2]) / np.maximum(np.bincount(at, minlength=count), 1)
    out = np.zeros_like(slices)
    out[:, held] = slices[:, held] / np.sqrt(np.maximum(power, epsilon))[:, at]
    return out


#: Views that are cut in one go: a volume is sent once for so many.
VIEWS = 1024


def by_view(volumes: DataFrame, views: DataFrame, side: int, of, names: list[str], key: str = "task", vector: str = "template", conditions: DataFrame | None = None, before=None) -> DataFrame:
    """key, view, condition (where there are any) and what the function makes of slices of every volume in every view (view, phi, theta, psi), each multiplied by
    the filter of every condition (condition, filter: of the slice's half spectrum), after what a function before makes of the slices alone. Views hang on the angular step, conditions on the defoci and pixel
    sizes, neither on the data: they come as arrays, in blocks of VIEWS and in one row, and a volume is a row for each block."""
    kind, held = volumes.schema[key].dataType.simpleString(), conditions is not None
    block = views.select("view", F.floor(F.col("view") / VIEWS).alias("block"), "phi", "theta", "psi")
    packed = block.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("view", "phi", "theta", "psi"))).alias("views"))
    pairs = volumes.select(F.col(key).alias("key"), F.col(vector).alias("vector")).crossJoin(packed)
    if held:
        pairs = pairs.crossJoin(F.broadcast(conditions.agg(F.sort_array(F.collect_list(F.struct("condition", "filter"))).alias("filters"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                full = spectrum(np.array(row["vector"], float).reshape((side,) * 3))
                view = pd.DataFrame(list(row["views"]))
                f = cut(full, rotations(view["phi"], view["theta"], view["psi"]), side)
                f = before(f) if before else f
                for c in row["filters"] if held else (None,):
                    made = of(f * np.array(c["filter"], float).reshape(f.shape[1:]) if held else f)
                    yield pd.DataFrame({key: row["key"], "view": view["view"].to_numpy(), **({"condition": c["condition"]} if held else {}), **{n: list(made[n].reshape(len(view), -1)) for n in names}})

    condition = f"condition {conditions.schema['condition'].dataType.simpleString()}, " if held else ""
    return pairs.mapInPandas(run, f"`{key}` {kind}, view int, {condition}" + ", ".join(f"{n} array<double>" for n in names))


def slices(volumes: DataFrame, views: DataFrame, side: int, **names: str) -> DataFrame:
    return by_view(volumes, views, side, spectral.parts, ["re", "im"], **names)


def projections(volumes: DataFrame, views: DataFrame, side: int, target: int, **names: str) -> DataFrame:
    """Projections normalised for a box of side target."""
    return by_view(volumes, views, side, lambda f: {"v": projected(f, side * side / target**2)}, ["v"], **names)


def filtered_projections(volumes: DataFrame, views: DataFrame, conditions: DataFrame, side: int, target: int, whiten: bool = False, **names: str) -> DataFrame:
    """Projections through the filter of every condition (condition, filter), normalised for a box of side target; whiten: each slice by its own curve first."""
    return by_view(volumes, views, side, lambda f: {"v": projected(f, side * side / target**2)}, ["v"], conditions=conditions, before=self_whitened if whiten else None, **names)


def embedded(v: Column, side: int, size: int) -> Column:
    """A square array in the middle of a larger one of zeros, turned so that its middle comes to the first place, as a template for a correlation."""
    turned = lambda c: F.pmod(c + side // 2, F.lit(size))
    y, x = lambda i: turned(F.floor(i / size).cast("int")), lambda i: turned(i % size)
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.when((y(i) < side) & (x(i) < side), F.get(v, y(i) * side + x(i))).otherwise(0.0))

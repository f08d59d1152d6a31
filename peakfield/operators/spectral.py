"""Fourier operators on square images held as arrays: every image is one row, transformed by numpy inside Arrow batches, so nothing is shuffled.

Forward transforms carry 1 / N and inverse ones are unscaled. A half spectrum has side rows (fy) of side // 2 + 1 columns (fx).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import written

TINY = 1e-12
#: Bytes of a block of images in a task: their spectra, maxima, moments and a score.
BLOCK_BYTES = 32 << 20
#: Images whose maxima are handed on together.
TOGETHER = 512


def signed(f: Column, n: int) -> Column:
    """Signed index of a frequency: -n // 2 to (n - 1) // 2."""
    return F.when(f < (n + 1) // 2, f).otherwise(f - n)


def by_image(images: DataFrame, side: int, of: Callable[[np.ndarray], dict[str, np.ndarray]], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and what the function makes of a stack of images: arrays of doubles."""
    names = list(of(np.zeros((1, side, side))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = of(np.array(batch[vector].tolist(), float).reshape(-1, side, side))
                yield pd.DataFrame({key: batch[key].to_numpy(), **{k: list(v.reshape(len(batch), -1)) for k, v in made.items()}})

    return images.select(key, vector).mapInPandas(run, f"`{key}` {images.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} array<double>" for n in names))


def parts(f: np.ndarray) -> dict[str, np.ndarray]:
    return {"re": f.real, "im": f.imag}


def forward(v: np.ndarray) -> np.ndarray:
    return np.fft.rfft2(v, norm="forward")


def without_origin(f: np.ndarray) -> np.ndarray:
    f = f.copy()
    f[:, 0, 0] = 0
    return f


def energy(f: np.ndarray, side: int) -> np.ndarray:
    """Energy of the full spectrum: columns that stand for their mates too count twice."""
    w = np.full(side // 2 + 1, 2.0)
    w[0] = 1
    if side % 2 == 0:
        w[-1] = 1
    return ((f.real**2 + f.imag**2) * w).sum((1, 2))


@lru_cache(8)
def radial_places(side: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """points of a radial curve; of each frequency the two points that share it and the second one's share; whether it is no explicit Hermitian mate."""
    points = int((side / 2 + 1) * math.sqrt(2) + 1)
    radius = np.hypot(np.fft.fftfreq(side)[:, None], np.fft.rfftfreq(side)[None]).ravel()
    at = np.clip(radius / (0.5 * math.sqrt(2) / (points - 1)), 0, points - 1)
    lo = at.astype(int)
    own = np.ones((side, side // 2 + 1), bool)
    own[side // 2 + 1 if side % 2 == 0 else (side + 1) // 2 :, 0] = False
    return points, lo, np.minimum(lo + 1, points - 1), at - lo, own.ravel()


def radial_power(f: np.ndarray) -> np.ndarray:
    """(images, points): mean power by distance from the origin; a frequency is shared by the two points beside it."""
    points, lo, hi, part, own = radial_places(f.shape[1])
    add = lambda v: np.bincount(lo[own], (v * (1 - part))[own], points) + np.bincount(hi[own], (v * part)[own], points)
    total = add(np.ones(len(lo)))
    power = np.stack([add(p) for p in (f.real**2 + f.imag**2).reshape(len(f), -1)]) if len(f) else np.zeros((0, points))
    return np.where(total > 0, power / np.maximum(total, TINY), 0)


def whitening(f: np.ndarray) -> np.ndarray:
    """(images, points): one over the root of the radial power, the largest being 1."""
    root = np.sqrt(radial_power(f))
    out = np.divide(1.0, root, out=np.zeros_like(root), where=root > 0)
    return out / np.maximum(out.max(1, keepdims=True), TINY)


def with_curve(f: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Spectra times their radial curves, looked up by interpolation."""
    _, lo, hi, part, _ = radial_places(f.shape[1])
    return f * (curve[:, lo] * (1 - part) + curve[:, hi] * part).reshape(f.shape)


def footprint(f: np.ndarray, side: int, pixels: float) -> np.ndarray:
    """Without the origin, and with unit energy for so many pixels."""
    f = f.copy()
    f[:, 0, 0] = 0
    return f / np.sqrt(np.maximum(energy(f, side), TINY) / max(pixels, 1.0))[:, None, None]


def first_pass(v: np.ndarray) -> np.ndarray:
    """Outliers beyond five deviations become the mean; then whitened, with unit energy, in real space again."""
    mean, dev = v.mean((1, 2), keepdims=True), v.std((1, 2), keepdims=True)
    f = forward(np.where(np.abs(v - mean) > 5 * dev, mean, v))
    f[:, 0, 0] = 0
    return np.fft.irfft2(footprint(with_curve(f, whitening(f)), v.shape[-1], 1), s=v.shape[1:], norm="forward")


def second_pass(v: np.ndarray, pixels: float) -> np.ndarray:
    """The spectrum about the image's middle, normalised to a template's footprint."""
    return footprint(forward(np.fft.ifftshift(v, axes=(1, 2))), v.shape[-1], pixels)


def resized(v: np.ndarray, size: int) -> np.ndarray:
    """Images cut or padded in Fourier space."""
    side = v.shape[-1]
    keep = min(side, size)
    a, b = (side - keep) // 2, (size - keep) // 2
    out = np.zeros((len(v), size, size), complex)
    out[:, b : b + keep, b : b + keep] = np.fft.fftshift(np.fft.fft2(v, norm="forward"), axes=(1, 2))[:, a : a + keep, a : a + keep]
    return np.fft.ifft2(np.fft.ifftshift(out, axes=(1, 2)), norm="forward").real


def correlated(images: DataFrame, tasks: DataFrame, side: int, key: str = "vec_id", vector: str = "embedding", digits: int = 9) -> DataFrame:
    """key, y, x, mip, task, s1, s2, n: the correlation of every image with every template at every shift; equal scores go to the lower task. tasks: task, template.

    Images are dealt into blocks of bounded bytes and templates into slices. A Spark task holds the spectra of one block while the templates of one slice
    stream by, and keeps the maximum and the moments of each place; it returns one row for each image, and the slices' rows are merged by one aggregation. Templates go
    from task to task, never through the driver."""
    spark = images.sparkSession
    tasks, images = written(tasks.select("task", "template"), "templates"), written(images.select(F.col(key).alias("key"), F.col(vector).alias("values")), "images")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-images.count() * (side * (side // 2 + 1) * 32 + side * side * 56) // BLOCK_BYTES))
    slices = max(1, -(-parts // blocks))
    kind = images.schema["key"].dataType.simpleString()
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = images.select(deal("key", blocks).alias("block"), every(slices).alias("slice"), F.lit(None).cast("long").alias("task"), "key", F.transform("values", lambda v: v.cast("double")).alias("values"))
    right = tasks.select(every(blocks).alias("block"), deal("task", slices).alias("slice"), F.col("task").cast("long").alias("task"), F.lit(None).cast(kind).alias("key"), F.transform("template", lambda v: v.cast("double")).alias("values"))
    # null tasks, the images, come first in each pair of a block and a slice
    dealt = left.union(right).repartition(max(parts, blocks * slices), "block", "slice").sortWithinPartitions("block", "slice", F.asc_nulls_first("task"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, names, held, spectra, best = None, [], [], None, {}

        def out() -> Iterator[pd.DataFrame]:
            if spectra is not None and best["n"]:
                for i in range(0, len(names), TOGETHER):
                    own = names[i : i + TOGETHER]
                    yield pd.DataFrame({"key": own, **{k: list(best[k][i : i + TOGETHER].reshape(len(own), -1)) for k in ("mip", "task", "s1", "s2")}, "n": best["n"]})

        for batch in batches:
            for (block, part), rows in batch.groupby(["block", "slice"], sort=False):
                if at != (block, part):
                    yield from out()
                    at, names, held, spectra, best = (block, part), [], [], None, {}
                new = rows["task"].isna().to_numpy()
                names += rows["key"][new].tolist()
                held += rows["values"][new].tolist()
                own = rows[~new]
                if not len(own) or not names:
                    continue
                if spectra is None:
                    spectra, held = forward(np.array(held, float).reshape(-1, side, side)), []
                    shape = (len(names), side, side)
                    best = {"mip": np.full(shape, -np.inf), "task": np.zeros(shape, np.int64), "s1": np.zeros(shape), "s2": np.zeros(shape), "n": 0}
                for task, values in zip(own["task"].astype(np.int64), own["values"], strict=True):
                    score = np.round(np.fft.irfft2(spectra * np.conj(forward(np.array(values, float).reshape(1, side, side))), s=(side, side), norm="forward"), digits)
                    more = score > best["mip"]  # tasks come in rising order
                    best["mip"][more], best["task"][more] = score[more], task
                    best["s1"] += score
                    best["s2"] += score * score
                    best["n"] += 1
        yield from out()

    found = dealt.mapInPandas(run, f"key {kind}, mip array<double>, task array<long>, s1 array<double>, s2 array<double>, n long")
    rows = found.select("key", "n", F.posexplode(F.arrays_zip("mip", "task", "s1", "s2")).alias("at", "e")).select("key", "n", "at", "e.*")
    top = F.max(F.struct("mip", (-F.col("task")).alias("t"))).alias("best")
    merged = rows.groupBy("key", "at").agg(top, F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))
    won = F.col("best.mip") > 0
    place = [F.expr(f"cast(at div {side} as int)").alias("y"), (F.col("at") % side).cast("int").alias("x")]
    return merged.select(F.col("key").alias(key), *place, F.when(won, F.col("best.mip")).otherwise(0.0).alias("mip"), F.when(won, -F.col("best.t")).alias("task"), "s1", "s2", "n")

"""Images brought to the size of a search, and result maps brought back, by the plans of `sizing`.

Every image or map is one row and is worked on by numpy inside Arrow batches, so nothing is shuffled; a search's nine maps are nine rows, as one row
of all of them would hold over a gigabyte at the largest size. Maps of continuous values are resampled in Fourier space, maps of labels go to the nearest
place. A row whose plan has an error, is missing or does not fit its values gets that as its `error` and no values; others go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .maps import nearest_offsets
from .sizing import cosine_within, radius

#: Which maps hold labels, which are filled with their mean outside the valid area, and which with a number.
LABELS = ("phi", "theta", "psi", "defocus", "pixel_size", "winner_task_index")
CONTINUOUS = ("mip", "correlation_sum", "correlation_sum_squares")
OUTSIDE = {"correlation_sum": 0.0, "correlation_sum_squares": 0.0, "winner_task_index": -1.0}
LEAST_WEIGHT, LEAST_ENERGY = 0.9, 1e-12
#: Values that a task holds before it hands them on.
HELD = 1 << 20


def centred(v: np.ndarray, shape: tuple[int, int], fill: float = 0.0) -> np.ndarray:
    """Cut or padded about the middle."""
    out = np.full(shape, fill, v.dtype)
    keep = [min(a, b) for a, b in zip(v.shape, shape, strict=True)]
    a, b = ([(n - k) // 2 for n, k in zip(s, keep, strict=True)] for s in (v.shape, shape))
    out[b[0] : b[0] + keep[0], b[1] : b[1] + keep[1]] = v[a[0] : a[0] + keep[0], a[1] : a[1] + keep[1]]
    return out


def mirrored(v: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Middles on each other, going on by mirroring with the edge repeated."""
    for axis, size in enumerate(shape):
        n = v.shape[axis]
        at = (np.arange(size) - size // 2 + n // 2) % (2 * n)
        v = v.take(np.where(at < n, at, 2 * n - 1 - at), axis)
    return v


def padded(v: np.ndarray, shape: tuple[int, int], mode: str, seed: int) -> np.ndarray:
    """Cut or padded about the middle: around it zeros, its edge's mean, its mirror image, or normal noise by the seed."""
    kept = centred(v, tuple(min(a, b) for a, b in zip(v.shape, shape, strict=True)))
    if mode == "replicate":
        return mirrored(kept, shape)
    edge = np.ones(kept.shape, bool)
    edge[1:-1, 1:-1] = False
    if mode == "noise":
        out = np.random.default_rng(seed).normal(size=shape)
    else:
        out = np.full(shape, {"zero": 0.0, "edge": float(kept[edge].mean())}[mode])
    a, b = ((n - k) // 2 for n, k in zip(shape, kept.shape, strict=True))
    out[a : a + kept.shape[0], b : b + kept.shape[1]] = kept
    return out


def fourier(v: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Cut or padded in Fourier space."""
    if v.shape == tuple(shape):
        return v
    spectrum = centred(np.fft.fftshift(np.fft.fft2(v, norm="forward")), shape)
    return np.fft.ifft2(np.fft.ifftshift(spectrum), norm="forward").real


def nearest(v: np.ndarray, known: np.ndarray, wanted: np.ndarray, reach: int) -> np.ndarray:
    """Wanted places that are not known take the nearest known value within reach along each axis; what is still open takes its neighbour's (left, right, above,
    below), round by round, from what was known before the round. Places that nothing reaches are an error."""

    def seen(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        out = np.zeros_like(a)
        h, w = a.shape
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
        return out

    out, open_ = v.copy(), wanted & ~known
    for _, _, dy, dx in sorted(nearest_offsets(reach)):
        if not open_.any():
            break
        if abs(dy) >= v.shape[0] or abs(dx) >= v.shape[1]:
            continue
        take = open_ & seen(known, dy, dx)
        out[take] = seen(v, dy, dx)[take]
        open_ &= ~take
    known = known | (wanted & ~open_)
    while open_.any():
        before, had = out.copy(), known.copy()
        for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)):
            take = open_ & seen(had, dy, dx)
            out[take] = seen(before, dy, dx)[take]
            open_ &= ~take
            known |= take
        if (known == had).all():
            raise ValueError("places of the valid area have no known place around them")
    return np.where(wanted, out, 0.0)


def pair(plan, kind: str) -> tuple[int, int]:
    return int(plan[f"{kind}_h"]), int(plan[f"{kind}_w"])


def before_search(v: np.ndarray, plan, mode: str, seed: int) -> np.ndarray:
    """An image at the size of its search: padded to a square, resampled without its mean and with unit energy, and padded; or only padded."""
    if plan["resampled"]:
        v = fourier(padded(v, pair(plan, "pre"), mode, seed), pair(plan, "crop"))
        v = v - v.mean()
        v = v / math.sqrt(max(float((v * v).mean()), LEAST_ENERGY))
    search = pair(plan, "search")
    if plan["rotated"]:
        search = search[::-1]
    if plan["resampled"] or plan["resized"]:
        v = padded(v, search, mode, seed + 1)
    return np.rot90(v) if plan["rotated"] else v


def valid_area(shape: tuple[int, int], plan) -> np.ndarray:
    """Places within the soft-edged rectangle about the middle where the edge's weight is high enough."""
    search = pair(plan, "search")[::-1] if plan["rotated"] else pair(plan, "search")
    y, x = (cosine_within(n, radius(s, b, plan["binning"], plan["resampled"])) for n, s, b in zip(shape, search, pair(plan, "before"), strict=True))
    return y[:, None] * x[None] >= LEAST_WEIGHT


def after_search(v: np.ndarray, name: str, plan, rescale: bool) -> tuple[np.ndarray, np.ndarray]:
    """A result map at the size of the image, and its valid area."""
    search, lower, upper = pair(plan, "search"), pair(plan, "lower"), pair(plan, "upper")
    if plan["rotated"]:
        v, search, lower, upper = np.rot90(v, -1), search[::-1], lower[::-1], upper[::-1]
        if name == "psi":
            v = (v + 90.0) % 360.0
            v = np.where(v == 0, 360.0, v)
    changed, original = plan["resampled"] or plan["resized"], (int(plan["original_h"]), int(plan["original_w"]))
    if changed:
        roi = v[lower[0] : upper[0] + 1, lower[1] : upper[1] + 1]
        if not rescale:
            return roi, np.ones(roi.shape, bool)
        v = mirrored(roi, search)
    known = None
    if plan["resized"]:
        v = centred(v, original)
    elif plan["resampled"] and name in CONTINUOUS:
        v = centred(fourier(centred(v, pair(plan, "crop")), pair(plan, "pre")), original)
    elif plan["resampled"]:
        factor = np.float32(plan["binning"])
        to = [np.trunc((np.arange(a, b + 1, dtype=np.float32) - np.float32(s // 2)) * factor).astype(int) + n // 2 for a, b, s, n in zip(lower, upper, search, original, strict=True)]
        if any((t < 0).any() or (t >= n).any() for t, n in zip(to, original, strict=True)):
            raise ValueError("a label falls outside the image")
        out, known = np.zeros(original), np.zeros(original, bool)
        out[np.ix_(*to)], known[np.ix_(*to)] = v[lower[0] : upper[0] + 1, lower[1] : upper[1] + 1], True
        v = out
    inside = valid_area(v.shape, plan)
    if not inside.any():
        raise ValueError("the valid area is empty")
    if known is not None:
        v = nearest(v, known, inside, max(1, math.ceil(plan["binning"])))
    return np.where(inside, v, OUTSIDE.get(name, float(v[inside].mean()))), inside


def _each(rows: DataFrame, key: str, values: str, plan: str, more: list[str], work) -> DataFrame:
    """key, the columns more, height, width, values, inside and error of what work makes of each row's values (flat), plan and further columns."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", *more, "height", "width", "values", "inside", "error"]
        whole = lambda held: pd.DataFrame(held, columns=names).astype({"height": "Int32", "width": "Int32"})
        for part in parts:
            held, size = [], 0
            for row in part.to_dict("records"):
                out, error = (None, None), None
                try:
                    if not isinstance(row["plan"], dict):
                        raise ValueError("there is no plan")
                    if row["plan"].get("error"):
                        raise ValueError(row["plan"]["error"])
                    if row["values"] is None:
                        raise ValueError("there are no values")
                    out = work(np.asarray(row["values"], float), row["plan"], row)
                except ValueError as problem:
                    error = str(problem)
                v, inside = out
                held.append((row["key"], *[row[m] for m in more], *((None,) * 4 if v is None else (*v.shape, v.ravel(), inside.ravel())), error))
                size += 0 if v is None else v.size
                if size > HELD:
                    yield whole(held)
                    held, size = [], 0
            if held:
                yield whole(held)

    from pyspark.sql import functions as F

    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(F.col(key).alias("key"), F.col(values).alias("values"), F.col(plan).alias("plan"), *more)
    made = own.mapInPandas(run, f"key {kind}, {''.join(f'`{m}` {rows.schema[m].dataType.simpleString()}, ' for m in more)}height int, width int, values array<double>, inside array<boolean>, error string")
    return made.withColumnRenamed("key", key)


def shaped(v: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    if v.size != shape[0] * shape[1]:
        raise ValueError(f"{v.size} values do not fill {shape[0]} x {shape[1]}")
    return v.reshape(shape)


def to_search(images: DataFrame, key: str, values: str, plan: str = "plan", mode: str = "noise", seed: int = 0) -> DataFrame:
    """key, height, width, values, inside (whether a place is in the valid area) and error for each image. Noise depends on the seed and the key alone."""
    import zlib

    if mode not in ("zero", "edge", "noise", "replicate"):
        raise ValueError(f"there is no padding {mode}")

    def work(v, p, row):
        out = before_search(shaped(v, (int(p["original_h"]), int(p["original_w"]))), p, mode, zlib.crc32(f"{seed} {row['key']}".encode()))
        inside = np.zeros(out.shape, bool)
        inside[int(p["lower_h"]) : int(p["upper_h"]) + 1, int(p["lower_w"]) : int(p["upper_w"]) + 1] = True
        return out, inside

    return _each(images, key, values, plan, [], work)


def from_search(maps: DataFrame, key: str, name: str, values: str, plan: str = "plan", rescale: bool = True) -> DataFrame:
    """key, name, height, width, values, inside and error for each result map; names are those of LABELS and CONTINUOUS."""

    def work(v, p, row):
        if row[name] not in LABELS + CONTINUOUS:
            raise ValueError(f"there is no map {row[name]}")
        return after_search(shaped(v, pair(p, "search")), row[name], p, rescale)

    return _each(maps, key, values, plan, [name], work)

"""Filters over half spectra, one array for each condition (an image, a defocus, a pixel size), built and resampled by array functions inside the row.

A half spectrum of a square of side n has n rows (fy) of n // 2 + 1 columns (fx). A filter is the product of what a microscope transfers, a radial curve
that was taken from an image, and any further functions of the frequency; its origin is zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import maps
from .spectral import signed


def places(side: int, of: Callable[[Column, Column], Column]) -> Column:
    """Array over the half spectrum of what a function makes of the signed indices (x, y)."""
    q = side // 2 + 1
    return F.transform(F.sequence(F.lit(0), F.lit(side * q - 1)), lambda i: of(i % q, signed(F.floor(i / q).cast("int"), side)))


def curve_at(curve: Column, radius: Column) -> Column:
    """A radial curve of evenly spaced points up to the corner of the spectrum, at a radius in cycles per pixel; the ends hold beyond them."""
    last = F.size(curve) - 1
    at = F.greatest(F.lit(0.0), F.least(last.cast("double"), radius / (math.sqrt(0.5) / last)))
    low = F.floor(at).cast("int")
    return F.get(curve, low) * (1 - (at - low)) + F.get(curve, F.least(low + 1, last)) * (at - low)


def condition_filter(side: int, transfer: Callable[[Column, Column], Column], curve: Column | None = None, extra: Iterable[Callable[[Column, Column], Column]] = (), scale: float = 1.0) -> Column:
    """The filter of a condition. transfer and each of extra: of (fx, fy) in cycles per pixel, all multiplied; scale: of the frequencies that transfer and curve see."""

    def value(x: Column, y: Column) -> Column:
        fx, fy = x / float(side), y / float(side)
        out = transfer(fx * scale, fy * scale)
        if curve is not None:
            out = out * curve_at(curve, F.sqrt(fx * fx + fy * fy) * scale)
        for more in extra:
            out = out * more(fx, fy)
        return F.when((x == 0) & (y == 0), 0.0).otherwise(out)

    return places(side, value)


def weighted_filters(side: int, transfer: Callable[[Column, Column], Column], pixel: Column, curve: tuple[float, float, float], kk: float, low: float, high: float, edge: float) -> tuple[Column, Column]:
    """Filters of an image and of a projection that weigh frequencies by their noise ratio, each within its band (cuts are resolutions in angstroms, edges pixels)."""
    ring = lambda r: F.lit(float(side)) * pixel / r

    def value(which: int) -> Callable[[Column, Column], Column]:
        def of(x: Column, y: Column) -> Column:
            fx, fy = x / float(side), y / float(side)
            radius = F.sqrt(fx * fx + fy * fy)
            weight = maps.frequency_weights(transfer(fx, fy), radius / pixel, curve, kk)[which]
            at = radius * side
            band = maps.template_bandpass(at, ring(high), edge) if which else maps.bandpass(at, ring(low), ring(high), edge)
            return F.when((x == 0) & (y == 0), 0.0).otherwise(weight * band)

        return of

    return places(side, value(0)), places(side, value(1))


def combined(image: Column, projection: Column) -> Column:
    """Both filters of a search as one, on the same grid."""
    return F.zip_with(image, projection, lambda a, b: a * b)


def sampled(values: Column, side: int, size: int, scale: Column | float) -> Column:
    """A filter of side at the places of a slice of another size, each index times scale, between four neighbours; zero where one of them is outside, and at the origin."""
    q, least, most = side // 2 + 1, -(side // 2), (side - 1) // 2

    def value(x: Column, y: Column) -> Column:
        u, v = x * F.lit(scale), y * F.lit(scale)
        i, j = F.floor(u).cast("int"), F.floor(v).cast("int")
        total = F.lit(0.0)
        for dy in (0, 1):
            for dx in (0, 1):
                total = total + F.get(values, F.pmod(j + dy, F.lit(side)) * q + F.least(i + dx, F.lit(q - 1))) * (1 - F.abs(u - i - dx)) * (1 - F.abs(v - j - dy))
        ok = (i + 1 <= side // 2) & (j >= least) & (j + 1 <= most) & ((x != 0) | (y != 0))
        return F.when(ok, total).otherwise(0.0)

    return places(size, value)

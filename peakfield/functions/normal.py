"""Tails of the normal distribution, and the threshold that a number of expected false positives asks for, as columns of rational functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: W. J. Cody's rational approximations of the error function and its complement, in double precision, numerator and denominator.
NEAR = ([1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3], [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3])
MIDDLE = ([2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3], [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3])
FAR = ([1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4], [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3])
#: P. J. Acklam's approximation of the normal quantile in the middle and in a tail.
CENTRE = ([-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0], [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0])
TAIL = ([-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0], [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0])
TAIL_FROM = 0.02425


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """What a function makes of a value that is computed once, however often the function uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _ratio(x: Column, parts: tuple[list[float], list[float]]) -> Column:
    def of(x: Column, own: list[float]) -> Column:
        v = F.lit(own[0])
        for c in own[1:]:
            v = v * x + F.lit(c)
        return v

    return let(x, lambda x: of(x, parts[0]) / of(x, parts[1]))


def _complement(y: Column) -> Column:
    """The complement of the error function from 0 on."""
    # exp(-y * y) with y split, so that the square of its leading part is exact
    bell = let(F.floor(y * 16.0) / 16.0, lambda lead: F.exp(-lead * lead) * F.exp(-(y - lead) * (y + lead)))
    far = let(1.0 / (y * y), lambda s: bell * (F.lit(1 / math.sqrt(math.pi)) - s * _ratio(s, FAR)) / y)
    return F.when(y <= 0.46875, 1.0 - y * _ratio(y * y, NEAR)).when(y <= 4.0, bell * _ratio(y, MIDDLE)).when(y < 27.3, far).otherwise(0.0)


def survival(z: Column | str) -> Column:
    """Probability of a value above z; null for null."""
    z = (F.col(z) if isinstance(z, str) else z).cast("double")
    half = let(F.greatest(F.abs(z) / math.sqrt(2), F.lit(1e-300)), _complement) * 0.5
    return F.when(F.isnan(z), z).when(z >= 0, half).when(z < 0, 1.0 - half)


def upper_quantile(p: Column | str) -> Column:
    """The value that is exceeded with probability p, bounded to what a double can hold; null for null."""
    own = (F.col(p) if isinstance(p, str) else p).cast("double")
    p = F.greatest(F.lit(2.0**-1022), F.least(F.lit(1 - 2.0**-53), own))

    def of(small: Column) -> Column:
        first = F.when(small < TAIL_FROM, -_ratio(F.sqrt(-2.0 * F.log(small)), TAIL)).otherwise(let(0.5 - small, lambda q: q * _ratio(q * q, CENTRE)))
        # two of Halley's steps on the tail, relative to its density
        for _ in range(2):
            first = let(first, lambda z: F.when(z > 37.0, z).otherwise(let((survival(z) - small) * math.sqrt(2 * math.pi) * F.exp(z * z / 2.0), lambda off: z + off / (1.0 - z * off / 2.0))))
        return first

    value = let(p, lambda p: let(let(F.least(p, 1.0 - p), of), lambda z: F.when(p <= 0.5, z).otherwise(-z)))
    return F.when(F.isnan(own), own).when(own.isNotNull(), value)


def threshold(false_positives: Column, trials: Column) -> Column:
    """The score that noise alone exceeds that many times in so many trials."""
    return upper_quantile(false_positives.cast("double") / trials.cast("double"))


def independent_trials(pixels: Column, searched: Column, fraction: float, defoci: int = 1, ignore_defocus: bool = False) -> Column:
    """The trials of a search that count as independent; where the defocus is ignored, its positions count once. Counts that are not positive are an error."""
    own = pixels.cast("double") * searched.cast("double") * fraction / (max(defoci, 1) if ignore_defocus else 1)
    return F.when((pixels > 0) & (searched > 0), own).otherwise(F.raise_error(F.lit("search counts must be positive")).cast("double"))

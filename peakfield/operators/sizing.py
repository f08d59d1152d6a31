"""Sizes of a search: resolution limit, binning, crop, pads, areas that count. One plan for each distinct shape and setting, all as columns.

Single precision decides which sizes come out, so every step that the search rounds to single precision is cast to it here. The binning scan is
a search over integer offsets: the pre-scaling size grows (or, if the result does not fit the image, shrinks) by one until the realised
binning is close enough to the wanted one, or the search size passes its limit; of all offsets up to there the closest is taken, and of equals
the first. Offsets are generated for each distinct square, pixel size and binning, and reduced where they are generated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest search size, allowed error of a pixel in angstrom, factor limits in the order in which they are tried, and primes.
MOST_SIZE = 4096
PIXEL_ERROR = 0.00005
LIMITS = (2, 3, 5, 7, 9, 13)
PRIMES = (2, 3, 5, 7, 11, 13)

#: Sizes up to here can be looked up.
LARGEST = 1 << 20


def smooth(limit: int, most: int = LARGEST) -> list[int]:
    """Even numbers up to most whose prime factors are at most limit, sorted."""
    found = {2}
    for p in (p for p in PRIMES if p <= limit):
        own = list(found)
        while own:
            own = [n * p for n in own if n * p <= most]
            found.update(own)
    return sorted(found)


def next_of(value: Column, sizes: list[int]) -> Column:
    """The smallest of the sorted sizes from value on; an error beyond them."""
    # one literal, which the optimizer turns into an array once
    table = F.from_json(F.lit(str(sizes)), "array<int>")
    found = F.array_min(F.filter(table, lambda n: n >= value))
    return F.coalesce(found, F.raise_error(F.lit("a size is beyond all that can be transformed")).cast("int"))


def factorized_upper(value: Column, limit: int) -> Column:
    """The next even size with no prime factor over limit; for 2, the next power of two."""
    return next_of(F.greatest(value, F.lit(2)), smooth(limit))


def power_of_two(value: Column) -> Column:
    return next_of(value, [1 << k for k in range(31)])


def nice_size(value: Column, mode: str = "standard") -> Column:
    """A size that transforms fast. standard: of the factor limits in their order, the first whose next even size is less than a tenth larger."""
    if mode == "exact":
        return value
    if mode == "power2":
        return power_of_two(value)
    tries = [factorized_upper(value, k) for k in LIMITS]
    return F.coalesce(*[F.when((t - value).cast("double") < value.cast("double") * 0.1, t) for t in tries], tries[-1])


def single(c: Column) -> Column:
    return c.cast("float")


def binned(size: Column, factor: Column) -> Column:
    """The size over the factor, rounded half up in single precision."""
    return single(single(single(size) / single(factor)) + single(F.lit(0.5))).cast("int")


def realized(wanted: Column, size: Column) -> Column:
    """The binning that an even size of at least 2 gives."""
    near = F.greatest(F.lit(2), binned(size, wanted))
    return single(single(size) / single(near + near % 2))


def scanned(rows: DataFrame, step: int) -> DataFrame:
    """For each distinct square, target_binning and pixel of rows: error, factor and size of the closest binning of all offsets up to the first that will do,
    and stop, that one's number of steps. No row if none will do while there is a size left."""
    spark, on = rows.sparkSession, ["square", "target_binning", "pixel"]
    own = rows.select(*on).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *on)
    wanted = F.col("target_binning")
    last = F.greatest(F.lit(0), F.ceil(wanted.cast("double") * (MOST_SIZE + 6)).cast("int") - F.col("square")) if step > 0 else F.col("square") - 2

    def tried(own: DataFrame, last: Column) -> DataFrame:
        each = own.where(last >= 0).withColumn("k", F.explode(F.sequence(F.lit(0), last))).withColumn("n", F.col("square") + F.col("k") * step)
        each = each.withColumn("factor", realized(wanted, F.col("n")))
        return each.withColumns({"size": binned(F.col("n"), F.col("factor")), "error": F.abs(wanted.cast("double") - F.col("factor").cast("double"))})

    ends = (F.col("error") * single(F.col("pixel")).cast("double") < PIXEL_ERROR) | (F.col("size") > MOST_SIZE)
    stops = tried(own, last).where(ends).groupBy(*on).agg(F.min("k").alias("stop"))
    best = tried(stops, F.col("stop")).groupBy(*on, "stop").agg(F.min_by(F.struct("error", "factor", "size"), F.struct("error", "k")).alias("b"))
    return best.select(*on, "stop", "b.*")


def split_padding(total: Column, size: Column) -> tuple[Column, Column]:
    """Before and after; an odd pixel goes after an even size, and before an odd one. A negative total is halved downwards."""
    half, odd = F.floor(total / 2).cast("int"), F.pmod(total, F.lit(2)).cast("int")
    return half + F.when(size % 2 == 0, 0).otherwise(odd), half + F.when(size % 2 == 0, odd).otherwise(0)


def planned(images: DataFrame, height: str = "height", width: str = "width", template: str = "template", pixel: str = "pixel_size", limit: str = "resolution", *, max_search_size: int = 1024, size_mode: str = "standard", statistics: str = "source", border: int | None = None, threshold: str = "source", rotate: bool = False, name: str = "plan") -> DataFrame:
    """images with a struct: everything a search of that shape, template side, pixel size and resolution limit needs, and `error` (null, or why such a search
    cannot be run; the sizes that it concerns are then out of range). Plans are made once for each distinct set of these and joined to the images."""
    keys = [height, width, template, pixel, limit]
    rows = images.select(*[F.col(k).alias(a) for k, a in zip(keys, ("h", "w", "t", "pixel", "wanted"), strict=True)]).distinct()
    given = rows.columns
    pix, two = single(F.col("pixel")), single(F.lit(2.0))
    nyquist = single(two * pix)
    even = max_search_size + max_search_size % 2
    side_limit = lambda n: single(nyquist * single(single(n) / single(F.lit(even))))
    large = (F.col("h") > max_search_size) | (F.col("w") > max_search_size)
    rows = rows.withColumns({"h": F.col("h").cast("int"), "w": F.col("w").cast("int"), "t": F.col("t").cast("int"), "max_search_size_applied": large})
    rows = rows.withColumns({"resolution": F.when(large, F.greatest(side_limit(F.col("w")), side_limit(F.col("h")))).otherwise(F.greatest(single(F.col("wanted")), nyquist))})
    res, ny = F.col("resolution").cast("double"), nyquist.cast("double")
    rows = rows.withColumns({"resampled": F.abs(res - ny) > F.greatest(1e-6 * F.greatest(res, ny), F.lit(1e-6)), "square": F.greatest("h", "w"), "target_binning": single(single(single(F.col("resolution")) / pix) / two)})
    need, on = rows.where("resampled"), ["square", "target_binning", "pixel"]
    up = scanned(need, 1)
    tried = rows.join(up.select(*on, F.struct("stop", "error", "factor", "size").alias("up")), on, "left")
    fits = F.coalesce((F.col("up.size") <= F.col("h")) & (F.col("up.size") <= F.col("w")), F.lit(False))
    tried = tried.withColumn("fits", fits)
    down = scanned(tried.where("resampled and not fits"), -1)
    rows = tried.join(down.select(*on, F.struct("stop", "error", "factor", "size").alias("down")), on, "left")
    rows = rows.withColumns({"scan": F.when(F.col("fits"), F.col("up")).otherwise(F.col("down")), "bin_offset": F.when(F.col("fits"), F.col("up.stop")).otherwise(-F.col("down.stop"))})
    rs = F.col("resampled")
    rows = rows.withColumns({
        "error": F.when(rs & F.col("scan").isNull(), "no binning is close enough"),
        "binning": F.when(rs, F.col("scan.factor")).otherwise(single(F.lit(1.0))),
        "factor_error": F.when(rs, F.col("scan.error")).otherwise(F.abs(F.col("target_binning").cast("double") - 1.0)),
        "bin_offset": F.when(rs, F.col("bin_offset")).otherwise(0),
    })
    rows = rows.withColumns({"pre_h": F.when(rs, F.col("square") + F.col("bin_offset")).otherwise(F.col("h")), "pre_w": F.when(rs, F.col("square") + F.col("bin_offset")).otherwise(F.col("w"))})
    rows = rows.withColumns({"crop_h": F.when(rs, F.col("scan.size")).otherwise(F.col("h")), "crop_w": F.when(rs, F.col("scan.size")).otherwise(F.col("w"))})
    rows = rows.withColumns({f"search_{a}": nice_size(F.col(f"crop_{a}"), size_mode) for a in "hw"})
    rows = rows.withColumn("resized", ~rs & ((F.col("search_h") != F.col("h")) | (F.col("search_w") != F.col("w"))))
    pads: dict[str, Column] = {}
    for a in "hw":
        total = F.when(rs, F.col(f"pre_{a}") - F.col(a)).otherwise(F.col(f"search_{a}") - F.col(f"crop_{a}"))
        pads[f"first_before_{a}"], pads[f"first_after_{a}"] = split_padding(total, F.col(a))
    rows = rows.withColumns(pads)
    inner = {f"fft_{s}_{a}": F.when(rs, F.floor((F.col(f"search_{a}") - F.col(f"crop_{a}")) / 2).cast("int")).otherwise(F.col(f"first_{s}_{a}")) for a in "hw" for s in ("before", "after")}
    rows = rows.withColumns(inner)
    rows = rows.withColumns({f"{s}_{a}": F.when(rs, F.ceil(F.col(f"first_{s}_{a}").cast("double") / F.col("binning").cast("double")).cast("int") + F.col(f"fft_{s}_{a}")).otherwise(F.col(f"first_{s}_{a}")) for a in "hw" for s in ("before", "after")})
    rows = rows.withColumns({f"lower_{a}": F.col(f"before_{a}") for a in "hw"} | {f"upper_{a}": F.col(f"search_{a}") - 1 - F.col(f"after_{a}") for a in "hw"})
    own = {"full": lambda a: (F.lit(0), F.col(f"search_{a}") - 1), "source": lambda a: (F.col(f"lower_{a}"), F.col(f"upper_{a}"))}
    own["precompiled"] = lambda a: (F.col(f"lower_{a}") + (F.col(f"fft_before_{a}") if border is None else border), F.col(f"upper_{a}") - (F.col(f"fft_after_{a}") if border is None else border))
    stats = {a: own[statistics](a) for a in "hw"}
    rows = rows.withColumns({f"stats_lower_{a}": stats[a][0] for a in "hw"} | {f"stats_upper_{a}": stats[a][1] for a in "hw"})
    size = lambda kind, a: F.col(f"{kind}upper_{a}") - F.col(f"{kind}lower_{a}") + 1
    rows = rows.withColumns({f"roi_{a}": size("", a) for a in "hw"} | {f"stats_{a}": size("stats_", a) for a in "hw"})
    area = lambda kind: (F.col(f"{kind}_h").cast("long") * F.col(f"{kind}_w"))
    counted = {"source": area("roi"), "statistics": area("stats"), "full": area("search")}[threshold]
    cropped = binned(F.col("t"), F.col("binning"))
    side = {"power2": power_of_two, "exact": lambda c: c}.get(size_mode, lambda c: factorized_upper(c, 5))(F.col("template_crop"))
    is_power = lambda c: F.expr(f"{c} & ({c} - 1) = 0")
    turned = ~is_power("search_w") & is_power("search_h") if rotate and size_mode != "power2" else F.lit(False)
    rows = rows.withColumns({
        "error": F.coalesce("error", F.when((F.col("roi_h") <= 0) | (F.col("roi_w") <= 0), "sizing leaves no valid area"), F.when((F.col("stats_h") <= 0) | (F.col("stats_w") <= 0), "statistics have no area")),
        "valid_pixels": area("roi"), "statistics_pixels": area("stats"), "threshold_pixels": counted, "normalization_pixels": area("roi"),
        "search_pixel_size": single(pix * F.col("binning")), "binning_error": single(F.col("factor_error") * pix.cast("double")),
        "template_crop": cropped, "rotated": turned,
    })
    rows = rows.withColumn("template_search", side)
    rows = rows.withColumns({f"output_{a}": F.when(rs | F.col("resized"), F.col(f"roi_{a}")).otherwise(F.col(f"search_{a}")) for a in "hw"})
    for pair in [("search_h", "search_w"), *[(f"{k}_h", f"{k}_w") for k in ("lower", "upper", "roi", "stats_lower", "stats_upper", "stats")]]:
        x, y = pair
        rows = rows.withColumns({x: F.when(F.col("rotated"), F.col(y)).otherwise(F.col(x)), y: F.when(F.col("rotated"), F.col(x)).otherwise(F.col(y))})
    rows = rows.withColumns({"original_h": F.col("h"), "original_w": F.col("w")})
    fields = [c for c in rows.columns if c not in {*given, "square", "up", "down", "fits", "scan", "factor_error"}]
    plans = rows.select(*[F.col(c).alias(f"k_{c}") for c in given], F.struct(*fields).alias(name))
    on = [images[k].eqNullSafe(plans[f"k_{c}"]) for k, c in zip(keys, given, strict=True)]
    return images.join(plans, on, "left").select(*[images[c] for c in images.columns], plans[name])


def radius(search: int, before: int, binning: float, resampled: bool) -> float:
    """Half the extent of the valid area about the middle, in pixels of the output."""
    return (search // 2 - before) * (binning if resampled else 1.0)


def cosine_within(size: int, reach: float, edge: float = 7.0):
    """Weights along an axis: 1 near the middle, falling by a raised cosine over the edge."""
    import numpy as np

    d, inner = np.abs(np.arange(size) - size // 2).astype(float), max(reach - 0.5 * edge, 0.0)
    return np.where(d <= inner, 1.0, np.where(d < inner + edge, (1 + np.cos(math.pi * (d - inner) / edge)) * 0.5, 0.0))

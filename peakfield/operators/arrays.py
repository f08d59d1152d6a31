"""Reductions and resampling of square images held as arrays, in long form (y, x, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixels(images: DataFrame, side: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return images.select(key, F.posexplode(vector).alias("at", "v")).select(key, F.expr(f"at div {side}").cast("int").alias("y"), (F.col("at") % side).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def edge(side: int):
    return F.col("y").isin(0, side - 1) | F.col("x").isin(0, side - 1)


def edge_mean(px: DataFrame, side: int, key: str = "vec_id") -> DataFrame:
    return px.where(edge(side)).groupBy(key).agg(F.avg("v").alias("edge_mean"), F.count("*").alias("n"))


def mean_fill(px: DataFrame, inside, key: str = "vec_id") -> DataFrame:
    """Values outside a mask become the mean of those inside, image by image."""
    means = px.where(inside).groupBy(key).agg(F.avg("v").alias("mean"))
    return px.join(means, key).select(key, "y", "x", F.when(inside, F.col("v")).otherwise(F.col("mean")).alias("v"))


def radial(px: DataFrame, side: int) -> DataFrame:
    """Power by distance from the centre: each sample goes to the two bins beside its radius, by its distance from them; weighted mean."""
    c = side // 2
    r = F.sqrt(((F.col("y") - c) * (F.col("y") - c) + (F.col("x") - c) * (F.col("x") - c)).cast("double"))
    rows = px.select(r.alias("r"), (F.col("v") * F.col("v")).alias("p")).withColumn("lo", F.floor("r")).withColumn("f", F.col("r") - F.col("lo"))
    two = rows.select("p", F.explode(F.array(F.struct(F.col("lo").alias("bin"), (1 - F.col("f")).alias("w")), F.struct((F.col("lo") + 1).alias("bin"), F.col("f").alias("w")))).alias("s"))
    return two.groupBy("s.bin").agg((F.sum(F.col("p") * F.col("s.w"))).alias("pw"), F.sum("s.w").alias("w")).where("w > 0").select("bin", (F.col("pw") / F.col("w")).alias("power"))


def radial_nearest(px: DataFrame, side: int) -> DataFrame:
    """The nearest bin, floor(r + 0.5) - 1, for bins 0 to side / 2 - 1, unweighted."""
    c = side // 2
    r = F.sqrt(((F.col("y") - c) * (F.col("y") - c) + (F.col("x") - c) * (F.col("x") - c)).cast("double"))
    b = (F.floor(r + 0.5) - 1).alias("bin")
    return px.select(b, (F.col("v") * F.col("v")).alias("p")).where(f"bin between 0 and {side // 2 - 1}").groupBy("bin").agg(F.avg("p").alias("power"))


def hermitian_energy(px: DataFrame, side: int, key: str = "vec_id") -> DataFrame:
    """Energy of a half spectrum: columns 0 and side - 1 stand once, others stand for their mates too."""
    w = F.when(F.col("x").isin(0, side - 1), 1.0).otherwise(2.0)
    return px.groupBy(key).agg(F.sum(F.col("v") * F.col("v") * w).alias("energy"))


def mirrored(px: DataFrame, side: int, pad: int, key: str = "vec_id") -> DataFrame:
    """Images padded by mirroring, period 2 * side. Every source value finds its places by the inverse rule, so nothing is joined."""
    places = lambda c: F.expr(f"filter(sequence({-pad}, {side + pad - 1}), i -> if(pmod(i, {2 * side}) < {side}, pmod(i, {2 * side}), {2 * side - 1} - pmod(i, {2 * side})) = {c})")
    rows = px.select(key, F.explode(places("y")).alias("ty"), "x", "v").select(key, F.col("ty").alias("y"), F.explode(places("x")).alias("tx"), "v")
    return rows.select(key, "y", F.col("tx").alias("x"), "v")


def replace_outliers(df: DataFrame, value: str, sigmas: float = 5.0) -> DataFrame:
    """Values further than so many population deviations from the mean become the mean."""
    one = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    far = F.abs(F.col(value) - F.col("m")) > sigmas * F.col("s")
    return df.crossJoin(F.broadcast(one)).withColumn(value, F.when(far, F.col("m")).otherwise(F.col(value))).drop("m", "s")


def scatter(atoms: DataFrame, half: int, size: int) -> DataFrame:
    """atoms: x, y, w (integers). Each adds w times a triangular kernel to the half-open box [x - half, x + half) around it, clipped to [0, size - 1)."""
    span = lambda c: F.sequence(F.greatest(F.col(c) - half, F.lit(0)), F.least(F.col(c) + half, F.lit(size - 1)) - 1)
    ok = " and ".join(f"greatest({c} - {half}, 0) < least({c} + {half}, {size - 1})" for c in "xy")
    rows = atoms.where(ok).select("x", "y", "w", F.explode(span("x")).alias("vx")).select("*", F.explode(span("y")).alias("vy"))
    k = (half + 1 - F.abs(F.col("vx") - F.col("x"))) * (half + 1 - F.abs(F.col("vy") - F.col("y")))
    return rows.groupBy("vx", "vy").agg(F.sum(F.col("w") * k).alias("density"))


def whitening(curve: DataFrame) -> DataFrame:
    """1 / sqrt(power) of each bin of a radial curve, the largest being 1; a curve has as many bins as an image has rings."""
    w = curve.where("power > 0").select("bin", (1 / F.sqrt("power")).alias("w"))
    return w.crossJoin(F.broadcast(w.agg(F.max("w").alias("most")))).select("bin", (F.col("w") / F.col("most")).alias("weight"))


def centered(images: DataFrame, side: int, size: int, fill: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Images cut or padded about their middle to another size. Each place looks its value up in the image's own array, so nothing is joined."""
    keep = min(side, size)
    back = (side - keep) // 2 - (size - keep) // 2
    at = lambda c: F.col(c) + back
    rows = images.select(key, vector, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("x"))
    inside = at("y").between(0, side - 1) & at("x").between(0, side - 1)
    return rows.select(key, "y", "x", F.when(inside, F.get(vector, at("y") * side + at("x")).cast("double")).otherwise(fill).alias("v"))


def padded(images: DataFrame, side: int, size: int, mode: str, seed: int = 0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Images in the middle of a square of another size; around them zeros, their own edge mean (of what was kept), their mirror image, or normal noise that the
    key, the place and the seed give, so that a task that runs again draws the same. copied: whether a place comes from the image."""
    keep = min(side, size)
    first, to = (side - keep) // 2, (size - keep) // 2
    y, x = F.col("y"), F.col("x")
    at = lambda row, col: F.get(vector, (row + first) * side + col + first).cast("double")
    # the edge's places, in rows of the kept square: its first and last row, and both ends of those between
    line = lambda i: F.when((i == 0) | (i == keep - 1), F.sequence(F.lit(0), F.lit(keep - 1))).otherwise(F.array(F.lit(0), F.lit(keep - 1)))
    edge = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.transform(line(i), lambda j: at(i, j))))
    own = images.select(key, vector, (F.aggregate(edge, F.lit(0.0), lambda a, v: a + v) / F.size(edge) if mode == "edge" else F.lit(0.0)).alias("edge"))
    rows = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("x"))
    inside = y.between(to, to + keep - 1) & x.between(to, to + keep - 1)
    draw = lambda k: (F.pmod(F.xxhash64(key, "y", "x", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    turn = lambda c: F.pmod(c - size // 2 + keep // 2, F.lit(2 * keep))
    mirror = lambda c: F.when(turn(c) < keep, turn(c)).otherwise(2 * keep - 1 - turn(c))
    around = {"zero": F.lit(0.0), "edge": F.col("edge"), "noise": F.sqrt(-2 * F.log(draw(0))) * F.cos(2 * F.pi() * draw(1)), "replicate": at(mirror(y), mirror(x))}[mode]
    value = around if mode == "replicate" else F.when(inside, at(y - to, x - to)).otherwise(around)
    return rows.select(key, "y", "x", value.alias("v"), inside.alias("copied"))


def shifted(px: DataFrame, side: int, down: int, right: int, fill: float, key: str = "vec_id") -> DataFrame:
    """Images moved without wrapping; places that nothing moves to take the fill. A value that leaves the image gives a filled place at the
    other end, so the number of rows stays."""
    y, x = F.col("y") + down, F.col("x") + right
    gone = ~(y.between(0, side - 1) & x.between(0, side - 1))
    return px.select(key, F.pmod(y, F.lit(side)).alias("y"), F.pmod(x, F.lit(side)).alias("x"), F.when(gone, fill).otherwise(F.col("v")).alias("v"))

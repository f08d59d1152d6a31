"""Atomic models in fixed-width PDB text, their centre, and their density on a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Atomic number and mass of the elements that the density model knows.
ELEMENTS = {"H": (1.0, 1.00794), "C": (6.0, 12.0107), "N": (7.0, 14.00674), "O": (8.0, 15.9994), "P": (15.0, 30.973761), "S": (16.0, 32.066)}


def parsed(lines: DataFrame, include_hetatm: bool = True, *keep: str) -> DataFrame:
    """The kept columns, record, chain, element, x, y, z of each line (value) that is an atom with readable coordinates. Serial numbers are ignored, so no atom is
    lost to a repeated one; a chain is kept as it stands. The element is that of columns 77-78, else the first letter of the atom's name."""
    line = F.col("value")
    place = lambda a: F.trim(F.substring(line, a, 8)).try_cast("float")
    stated = F.upper(F.trim(F.substring(line, 77, 2)))
    named = F.upper(F.regexp_extract(F.substring(line, 13, 4), r"\p{L}", 0))
    rows = lines.select(
        *keep, F.upper(F.trim(F.substring(line, 1, 6))).alias("record"), F.substring(line, 22, 1).alias("chain"), F.when(stated != "", stated).otherwise(named).alias("element"),
        place(31).alias("x"), place(39).alias("y"), place(47).alias("z"),
    )
    kinds = ("ATOM", "HETATM") if include_hetatm else ("ATOM",)
    return rows.where(F.col("record").isin(*kinds)).dropna(subset=["x", "y", "z"])


def read_pdb(spark: SparkSession, path: str, include_hetatm: bool = True) -> DataFrame:
    return parsed(spark.read.text(path), include_hetatm)


def element(which: int, name: Column) -> Column:
    """Atomic number (0) or mass (1); 0 for an element that is not in the table."""
    table = F.create_map(*[F.lit(v) for k, pair in ELEMENTS.items() for v in (k, pair[which])])
    return F.coalesce(F.try_element_at(table, name), F.lit(0.0))


def of_chains(atoms: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Atoms of the included chains but not of the excluded ones; an empty list asks for nothing."""
    if set(include or ()) & set(exclude or ()):
        raise ValueError("a chain is both included and excluded")
    if include:
        atoms = atoms.where(F.col("chain").isin(*include))
    return atoms.where(~F.col("chain").isin(*exclude)) if exclude else atoms


def center(atoms: DataFrame, *group: str) -> DataFrame:
    """Centre of mass of each group; zero where nothing has a mass."""
    mass = element(1, F.col("element"))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(mass * F.col(c).cast("double")), F.sum(mass)), F.lit(0.0)).alias(c)
    return atoms.groupBy(*group).agg(mean("x"), mean("y"), mean("z"), F.count("*").alias("atoms"))


def density(atoms: DataFrame, box: int, pixel: float, resolution: float, *group: str) -> DataFrame:
    """z, y, x, density of the voxels that atoms of each group reach. An atom adds to the half-open box of half-width w = 3 resolution / pixel around it, of
    which the last plane of the volume is never part; voxels are summed inside each partition before the shuffle."""
    fall = (math.pi / (resolution / pixel)) ** 2
    height, w = (fall / math.pi) ** 1.5, round(resolution * 3 / pixel)
    if w < 3:
        raise ValueError("the pixel is too large for this resolution")
    rows = atoms.select(*group, element(0, F.col("element")).alias("n"), *[(F.col(c).cast("double") / pixel + box / 2).alias(c) for c in "zyx"]).where("n > 0")
    low = {c: F.greatest(F.rint(F.col(c) - w), F.lit(0.0)).cast("int") for c in "zyx"}
    high = {c: F.least(F.rint(F.col(c) + w), F.lit(float(box - 1))).cast("int") for c in "zyx"}
    for c in "zyx":
        rows = rows.where(low[c] < high[c])
    for c in "zyx":
        rows = rows.withColumn(f"v{c}", F.explode(F.sequence(low[c], high[c] - 1)))
    far = F.sqrt(sum((F.col(f"v{c}") - F.col(c)) * (F.col(f"v{c}") - F.col(c)) for c in "zyx"))
    return rows.groupBy(*group, *[F.col(f"v{c}").alias(c) for c in "zyx"]).agg(F.sum(F.col("n") * height * F.exp(far * -fall)).alias("density"))


def line() -> Column:
    """The line of an atom: record, chain, element, x, y and z."""
    return F.format_string("%-6s%5d  %-3s MOL %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", "record", F.lit(1), "element", "chain", F.lit(1), F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"), F.lit(1.0), F.lit(0.0), "element")


def write_pdb(atoms: DataFrame, path: str) -> None:
    """Atom lines in as many text files as the table has partitions."""
    atoms.select(line().alias("value")).write.text(path)

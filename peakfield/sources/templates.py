"""Templates made from atomic models: the centre of the whole model, and the density of its chosen chains as a volume in an MRC file.

A model is a row, its text in a column. Both preparations are made once for each content and settings (see prepared): a model's centre does not hang
on chains, box or pixel, so templates of other chains share it. One task holds the voxels of one model, box cubed, when it writes the file.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mrc, pdb, prepared
from .files import write_bytes

#: What a centre file says.
CENTRE = "center_angstrom array<double>, pdb_sha256 string, include_hetatm boolean"
COMPOSITION = "array<struct<chain:string,element:string,atoms:bigint>>"


def atoms(models: DataFrame, content: str, include_hetatm: bool, *keep: str) -> DataFrame:
    """The atoms of every line of every model."""
    return pdb.parsed(models.select(*keep, F.explode(F.split(content, "\r?\n")).alias("value")), include_hetatm, *keep)


def composition(rows: DataFrame, *group: str) -> DataFrame:
    """Atoms of each group by chain and element, their number, and their centre of mass (zero where nothing has a mass)."""
    mass = pdb.element(1, F.col("element"))
    moment = lambda c: F.sum(mass * F.col(c).cast("double")).alias(c)
    kinds = rows.groupBy(*group, "chain", "element").agg(F.count("*").alias("atoms"), F.sum(mass).alias("mass"), *[moment(c) for c in "xyz"])
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("mass")), F.lit(0.0)).alias(c)
    return kinds.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("chain", "element", "atoms"))).alias("composition"), F.sum("atoms").alias("atoms"), F.struct(*[mean(c) for c in "xyz"]).alias("centre"))


def counted(kinds: Column, by: str) -> Column:
    """Map of the chains or elements of a composition to their numbers of atoms, in order."""
    names = F.array_sort(F.array_distinct(F.transform(kinds, lambda k: k[by])))
    total = lambda name: F.aggregate(F.filter(kinds, lambda k: k[by] == name), F.lit(0).cast("long"), lambda a, k: a + k["atoms"])
    return F.map_from_entries(F.transform(names, lambda name: F.struct(name, total(name))))


def without_number(kinds: Column) -> Column:
    """Atoms of a composition whose element the density model does not know."""
    return F.aggregate(F.filter(kinds, lambda k: pdb.element(0, k["element"]) == 0), F.lit(0).cast("long"), lambda a, k: a + k["atoms"])


def stated_centre(text: Column) -> Column:
    """x, y, z of a centre file's text, and an error where it does not hold three finite numbers."""
    at = F.from_json(text, CENTRE)["center_angstrom"]
    ok = (F.size(at) == 3) & F.forall(at, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(*[F.when(ok, F.get(at, F.lit(i))).alias(c) for i, c in enumerate("xyz")], F.when(~ok, "no three finite numbers").alias("error"))


def is_centre_of(text: Column, sha256: Column, include_hetatm: bool) -> Column:
    """Whether a centre file was made from this content with these records."""
    told = F.from_json(text, CENTRE)
    same = (told["pdb_sha256"] == sha256) & (F.coalesce(told["include_hetatm"], F.lit(False)) == include_hetatm) & (F.size(told["center_angstrom"]) == 3)
    return F.coalesce(same, F.lit(False))


def centres(models: DataFrame, content: str, uri: str, include_hetatm: bool = True) -> tuple[DataFrame, int]:
    """models with entry, sha256, centre, atoms and composition of the whole model, and how many were made now. A model without an atom has no centre."""

    def make(new: DataFrame) -> DataFrame:
        found = composition(atoms(new, content, include_hetatm, "entry"), "entry")
        return new.select("entry").join(found, "entry", "left").withColumn("atoms", F.coalesce("atoms", F.lit(0).cast("long")))

    return prepared.prepare(models, content, {"include_hetatm": include_hetatm}, make, f"{uri.rstrip('/')}/centres")


def centre_json(include_hetatm: bool) -> Column:
    """The centre file's text of a row that centres gives."""
    at = F.array(*[F.col("centre")[c] for c in "xyz"])
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("sha256").alias("pdb_sha256"), F.lit("mass_weighted").alias("center_method"), at.alias("center_angstrom"), F.lit(include_hetatm).alias("include_hetatm"),
        F.col("atoms").alias("atom_count"), (F.col("atoms") - without_number(F.col("composition"))).alias("mass_supported_atom_count"), counted(F.col("composition"), "chain").alias("chain_counts"), counted(F.col("composition"), "element").alias("element_counts")))


def templates(models: DataFrame, content: str, uri: str, box: int, pixel: float, resolution: float, include_hetatm: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, center: bool = True, y_flip: bool = False, reference: str | None = None) -> tuple[DataFrame, int, int]:
    """models with the volume made of each (file below uri/volumes, atoms, composition, shift, about: settings as JSON), and how many centres and volumes were made
    now. reference: a centre file's text that all models share. A model that has no atom, or none of the chosen chains, has no file but an error."""
    settings = {"schema_version": 1, "box": box, "pixel": pixel, "resolution": resolution, "include_hetatm": include_hetatm, "include": sorted(include or ()), "exclude": sorted(exclude or ()), "center": center, "y_flip": y_flip, "reference": None}
    if reference is None:
        own, made_centres = centres(models, content, uri, include_hetatm)
        known = own.groupBy("sha256").agg(F.first("centre").alias("centre"))
    else:
        told = json.loads(reference).get("center_angstrom")
        if not isinstance(told, list) or len(told) != 3 or not all(isinstance(v, (int, float)) and math.isfinite(v) for v in told):
            raise ValueError("the centre file does not hold three finite numbers")
        settings["reference"], made_centres, known = [float(v) for v in told], 0, None
    folder = f"{uri.rstrip('/')}/volumes"

    def store(part: pd.DataFrame) -> pd.DataFrame:
        v, held = np.zeros(box**3, np.float32), part["at"].to_numpy() >= 0
        v[part["at"].to_numpy()[held]] = part["v"].to_numpy()[held]
        v = v.reshape(box, box, box)
        name = f"{part['entry'].iloc[0]}.mrc"
        write_bytes(f"{folder}/{name}", mrc.encoded(v[:, ::-1] if y_flip else v, pixel))
        return pd.DataFrame({"entry": part["entry"].iloc[:1], "file": name})

    def make(new: DataFrame) -> DataFrame:
        chosen = pdb.of_chains(atoms(new, content, include_hetatm, "entry", "sha256"), include, exclude)
        at = F.struct(*[F.lit(v).alias(c) for v, c in zip(settings["reference"], "xyz", strict=True)]) if known is None else F.col("centre")
        placed = (chosen if known is None else chosen.join(known, "sha256")).select("entry", "chain", "element", *"xyz", F.struct(*[(-at[c] if center else F.lit(0.0)).alias(c) for c in "xyz"]).alias("shift"))
        moved = placed.select("entry", "element", *[(F.col(c).cast("double") + F.col("shift")[c]).alias(c) for c in "xyz"])
        voxels = pdb.density(moved, box, pixel, resolution, "entry").select("entry", ((F.col("z").cast("long") * box + F.col("y")) * box + F.col("x")).alias("at"), F.col("density").cast("float").alias("v"))
        # a model whose atoms all lie outside the box still has a volume, of zeros
        whole = composition(placed, "entry", "shift").select("entry", "shift", F.col("composition").alias("chosen"), F.col("atoms").alias("chosen_atoms"))
        files = voxels.union(whole.select("entry", F.lit(-1).cast("long"), F.lit(0.0).cast("float"))).groupBy("entry").applyInPandas(store, "entry string, file string")
        rows = new.select("entry").join(whole, "entry", "left").join(files, "entry", "left")
        return rows.select("entry", "file", F.coalesce("chosen_atoms", F.lit(0).cast("long")).alias("atoms"), F.coalesce("chosen", F.array().cast(COMPOSITION)).alias("composition"), "shift", F.when(F.col("file").isNull(), "no atom is left").alias("error"), F.lit(prepared.signature(settings)).alias("about"))

    found, made = prepared.prepare(models, content, settings, make, f"{uri.rstrip('/')}/templates")
    return found, made_centres, made

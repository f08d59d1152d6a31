"""Configurations of runs as rows: closed keys, overrides, rules, output names, counts of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(configs: DataFrame, text: str, keys: dict[str, tuple[str, object]], overrides: dict[str, Column] | None = None) -> DataFrame:
    """configs with a column for each key (its type and default) of the JSON object in a column, and unknown: sorted keys that no run knows. An override that
    is not null counts before what the object says, and that before the default. What is no JSON object says nothing."""
    own = F.from_json(text, "map<string,string>")
    said = configs.withColumn("unknown", F.coalesce(F.array_sort(F.array_except(F.map_keys(own), F.array(*[F.lit(k) for k in keys]))), F.array().cast("array<string>")))
    overrides = overrides or {}
    value = lambda k, kind, default: F.coalesce(*([overrides[k].cast(kind)] if k in overrides else []), F.try_element_at(own, F.lit(k)).try_cast(kind), F.lit(default).cast(kind))
    return said.withColumns({k: value(k, *v) for k, v in keys.items()})


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, sorted; a rule that is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items())]))


def stem(name: Column, index: Column) -> Column:
    """A relative path for a job's output: no empty, "." or ".." parts, and no suffix; a name without any other part gets the index."""
    left = F.array_join(F.filter(F.split(name, "/"), lambda p: ~p.isin("", ".", "..")), "/")
    return F.when(F.coalesce(left, F.lit("")) == "", F.format_string("micrograph_%06d", index)).otherwise(F.regexp_replace(left, r"([^/])\.[^./]+$", "$1"))


def piece(index: Column, total: int, pieces: int) -> Column:
    """The contiguous piece that a row (index from 0 of total) falls into; pieces differ by one row at most, larger ones first."""
    q, r = divmod(total, pieces)
    later = r + F.floor((index - r * (q + 1)) / F.lit(max(q, 1)))
    return F.when(index < r * (q + 1), F.floor(index / F.lit(q + 1))).otherwise(later).cast("int")


def plan(orientations: int, defoci: int, sizes: int, pixels: Column, fraction: float, bytes_per_value: int = 4) -> dict[str, Column]:
    """What a search will do: tasks, correlations of single pixels, independent trials, bytes of one map."""
    tasks = orientations * defoci * sizes
    return {"tasks": F.lit(tasks).cast("long"), "trials": pixels * tasks, "independent": pixels * tasks * F.lit(fraction), "map_bytes": pixels * bytes_per_value}


def labels(found: DataFrame, orientations: DataFrame, n_orientations: int, defoci: list[float], sizes: list[float], task: str = "task") -> DataFrame:
    """found with phi, theta, psi, defocus and pixel_size of the winning task; all are 0 where no task won. orientations: orientation, phi, theta, psi."""
    condition = F.expr(f"cast({task} div {n_orientations} as int)")
    pick = lambda values, at: F.coalesce(F.get(F.array(*[F.lit(float(v)) for v in values]), at), F.lit(0.0))
    rows = found.withColumn("orientation", F.col(task) % n_orientations).join(orientations, "orientation", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("phi", "theta", "psi")} | {"defocus": pick(defoci, condition % len(defoci)), "pixel_size": pick(sizes, (condition / len(defoci)).cast("int"))}).drop("orientation")

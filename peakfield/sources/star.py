"""STAR catalogs: loops of micrographs and optics groups.

Values run on over line ends, so a file is one row (wholetext) and one parse; catalogs of many files spread over tasks.
"""

from __future__ import annotations

import shlex
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import first_present

ROW = "file string, block string, row_index long, fields map<string,string>"
#: Names of the format's columns, the first present one counts, and whether optics groups may give them.
NAMES: dict[str, tuple[tuple[str, ...], bool]] = {
    "pixel_size": (("_rlnMicrographPixelSize", "_rlnMicrographOriginalPixelSize", "_rlnImagePixelSize"), True),
    "voltage": (("_rlnVoltage",), True),
    "spherical_aberration": (("_rlnSphericalAberration",), True),
    "amplitude_contrast": (("_rlnAmplitudeContrast",), True),
    "phase_shift": (("_rlnPhaseShift",), True),
    "defocus_u": (("_rlnDefocusU",), False),
    "defocus_v": (("_rlnDefocusV",), False),
    "defocus_angle": (("_rlnDefocusAngle",), False),
    "max_resolution": (("_rlnCtfMaxResolution",), False),
    "figure_of_merit": (("_rlnCtfFigureOfMerit",), False),
}
REQUIRED = ("defocus_u", "defocus_v")


def loops(text: str, name: str = "") -> Iterator[tuple[str, list[str], list[str]]]:
    """(block, columns, values) of each loop. A value line that begins with an underscore ends a loop; pairs outside of loops are passed over."""
    block, columns, values, inside = "", [], [], False
    for line in (*map(str.strip, text.splitlines()), "data_"):
        low = line.lower()
        if not line or line.startswith("#"):
            continue
        starts = low == "loop_" or low.startswith("data_")
        if inside and (starts or values and line.startswith("_")):
            if not columns or len(values) % len(columns):
                raise ValueError(f"{len(values)} values for {len(columns)} columns in a loop of data_{block} {name}")
            yield block, columns, values
            inside = False
        if starts:
            block = line[5:].strip() if low.startswith("data_") else block
            columns, values, inside = [], [], low == "loop_"
        elif inside and line.startswith("_"):
            columns.append(line.split()[0])
        elif inside:
            if line.startswith(";"):
                raise ValueError(f"values over several lines are not read {name}")
            values += shlex.split(line)


def read_star(spark: SparkSession, path: str) -> DataFrame:
    """One row for each row of each loop: file, block (lower case), row_index in the block, fields. Loops of one block with the same columns
    follow one another; with other columns they are an error."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, text in zip(part["file"], part["value"], strict=True):
                seen: dict[str, tuple[list[str], int]] = {}
                for block, columns, values in loops(text, name):
                    known, n = seen.get(block.lower(), (columns, 0))
                    if known != columns:
                        raise ValueError(f"loops of data_{block} differ in {name}")
                    rows = [dict(zip(columns, values[i : i + len(columns)], strict=True)) for i in range(0, len(values), len(columns))]
                    seen[block.lower()] = columns, n + len(rows)
                    yield pd.DataFrame({"file": name, "block": block.lower(), "row_index": range(n, n + len(rows)), "fields": rows})

    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(parse, ROW)


def number(text: Column, name: str) -> Column:
    """The number a text states; a text that states none is an error, null stays null."""
    value = text.try_cast("double")
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"no number for {name}: "), text)).cast("double")).otherwise(value)


def micrographs(rows: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Micrographs of read_star's rows with the settings of their optics group: all names in a micrograph's own row come before those of its
    group, and a default last. A later row of a group wins; a group that is not there is an error, and so is a missing defocus."""
    own = rows.where("block = 'micrographs'").select("file", "row_index", F.col("fields").alias("m"))
    own = own.withColumn("optics_group", F.coalesce(F.col("m")["_rlnOpticsGroup"], F.lit("1")))
    groups = rows.where("block = 'optics'").select(F.struct("file", F.col("fields")["_rlnOpticsGroup"].alias("optics_group")).alias("group"), "row_index", "fields")
    # maps have no order, so the group's last row is found by its index and carries its fields along
    last = groups.groupBy("group").agg(F.max_by("fields", "row_index").alias("o")).select("group.*", "o")
    both = own.join(last, ["file", "optics_group"], "left")
    both = both.withColumn("o", F.coalesce("o", F.raise_error(F.concat(F.lit("unknown optics group "), F.col("optics_group"))).cast("map<string,string>")))

    def field(name: str) -> Column:
        names, shared = NAMES[name]
        maps = ("m", "o") if shared else ("m",)
        texts = [F.col(m)[n] for m in maps for n in names]
        text = first_present(*texts, F.lit(None).cast("string"))
        missing = F.raise_error(F.concat(F.lit(f"no {name} in row "), F.col("row_index"))).cast("double") if name in REQUIRED else F.lit(defaults.get(name)).cast("double")
        return F.coalesce(number(text, name), missing).alias(name)

    return both.select("file", "row_index", F.col("m")["_rlnMicrographName"].alias("micrograph"), "optics_group", *[field(n) for n in NAMES])


def write_star(lines: DataFrame, path: str) -> None:
    """lines: file, block, columns (array), values (array), place. One STAR file for each value of file, rows in the order of place."""
    quoted = F.transform("values", lambda v: F.when(v.rlike(r"[\s']"), F.concat(F.lit('"'), v, F.lit('"'))).when(v == "", "''").otherwise(v))
    head = lines.groupBy("file", "block").agg(F.first("columns").alias("columns"))
    head = head.select("file", "block", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("\ndata_"), F.col("block"), F.lit("\n\nloop_\n"), F.array_join("columns", "\n")).alias("value"))
    body = lines.select("file", "block", F.col("place").cast("long").alias("place"), F.array_join(quoted, " ").alias("value"))
    ordered = head.union(body).repartition("file").sortWithinPartitions("file", "block", "place")
    ordered.select("file", "value").write.partitionBy("file").text(path)

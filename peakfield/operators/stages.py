"""Runs in named stages, each written and committed, so that a run can stop after one and go on from there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.commits import committed, commit

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def folder(path: str, at: int, name: str) -> str:
    return f"{path.rstrip('/')}/{at + 1:02d}_{name}"


def done(spark: SparkSession, path: str, stages: list[Stage]) -> DataFrame:
    """stage, name, committed and rows: what each stage has left so far."""
    told = []
    for i, (name, _) in enumerate(stages):
        try:
            told.append((i + 1, name, True, committed(spark, folder(path, i, name))["rows"]))
        except ValueError:
            told.append((i + 1, name, False, None))
    return spark.createDataFrame(told, "stage int, name string, committed boolean, rows long")


def run(start: DataFrame, stages: list[Stage], path: str, stop_after: int = 0) -> DataFrame:
    """What the last stage, or stage stop_after (from 1; 0: none), makes of start. A stage's input is what the one before has written. Stages up to the last
    committed one are not run again; a stage that was cut off before its commit is written anew."""
    if len({n for n, _ in stages}) < len(stages) or not stages:
        raise ValueError("stages need names of their own")
    if not 0 <= stop_after <= len(stages):
        raise ValueError(f"there is no stage {stop_after}")
    spark, rows = start.sparkSession, start
    for i, (name, make) in enumerate(stages[: stop_after or len(stages)]):
        own = folder(path, i, name)
        try:
            about = committed(spark, own)
        except ValueError:
            made = make(rows)
            made.write.mode("overwrite").parquet(f"{own}/rows")
            about = {"stage": i + 1, "name": name, "rows": spark.read.parquet(f"{own}/rows").count(), "columns": made.columns}
            commit(spark, own, about)
        rows = spark.read.parquet(f"{own}/rows")
        if rows.columns != about["columns"]:
            raise ValueError(f"stage {name} has columns {rows.columns}, and its commit says {about['columns']}")
    return rows

"""Batches of jobs, each of which may fail without the others: one row of a manifest for each job, whatever became of it.

A job is a row; the work is a function of it that runs in a Spark task. What it raises becomes the job's error and traceback. Manifests of all attempts stand
in one folder, an attempt each, and a job that any of them has done is not run again.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Jobs whose rows are handed on together.
TOGETHER = 64

RESULT = "status string, elapsed_seconds double, error string, traceback string"


def attempted(jobs: DataFrame, work: Callable[[dict], dict], made: str, key: str = "index", tasks: int | None = None) -> DataFrame:
    """jobs with status (ok or failed), elapsed_seconds, error, traceback and the columns made (names and types) of what work returns; these are null where
    it failed. Jobs are dealt over tasks by their key, one after the other in each."""
    parts = tasks or int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.name for f in jobs.sparkSession.createDataFrame([], made).schema]
    clash = {n.lower() for n in [*names, "status", "elapsed_seconds", "error", "traceback"]} & {c.lower() for c in jobs.columns}
    if clash:
        raise ValueError(f"jobs have columns that the manifest makes: {sorted(clash)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # what jobs return is handed on some jobs at a time, as a frame for each job costs more than most work
            for first in range(0, len(batch), TOGETHER):
                own, told = batch.iloc[first : first + TOGETHER].reset_index(drop=True), []
                for row in own.to_dict("records"):
                    job = {k: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for k, v in row.items()}
                    began, out, error, trace = time.perf_counter(), {}, None, None
                    try:
                        out = work(job)
                        out = {n: out.get(n) for n in names}
                    except Exception as problem:  # a job's failure is its row, not the batch's end
                        error, trace, out = f"{type(problem).__name__}: {problem}", traceback.format_exc(), dict.fromkeys(names)
                    told.append({"status": "failed" if error else "ok", "elapsed_seconds": time.perf_counter() - began, "error": error, "traceback": trace} | out)
                # objects keep whole numbers whole beside nulls
                yield pd.concat([own, pd.DataFrame(told, dtype=object)], axis=1)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema)
    return jobs.repartition(parts, key).mapInPandas(run, f"{columns}, {RESULT}, {made}")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """All attempts (a column) at all jobs, or None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run(jobs: DataFrame, work: Callable[[dict], dict], made: str, path: str, key: str = "index", continue_on_error: bool = True, tasks: int | None = None) -> DataFrame:
    """One more attempt at the jobs that no attempt has done; the last row of each job from the manifest in path. Where errors are not to be passed over,
    the first failed job's error is raised after the manifest is written."""
    spark = jobs.sparkSession
    if jobs.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} does not name each job")
    before = manifest(spark, path)
    attempt = 1 if before is None else before.agg(F.max("attempt")).first()[0] + 1
    left = jobs if before is None else jobs.join(before.where("status = 'ok'").select(key), key, "left_anti").select(*jobs.columns)
    attempted(left, work, made, key, tasks).write.parquet(f"{path.rstrip('/')}/attempt={attempt}")
    every = spark.read.parquet(path).where(F.col("attempt") <= attempt)  # later attempts do not change what this one returned
    last = every.groupBy(key).agg(F.max("attempt").alias("attempt"))
    out = every.join(last, [key, "attempt"])
    if not continue_on_error:
        bad = out.where("status != 'ok'").orderBy(key).limit(1).collect()
        if bad:
            raise RuntimeError(f"job {bad[0][key]} failed: {bad[0]['error']}")
    return out


def rollup(jobs: DataFrame) -> DataFrame:
    """Done and failed jobs and their seconds: one row."""
    return jobs.agg(F.count_if(F.col("status") == "ok").alias("successful"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("elapsed_seconds").alias("elapsed_seconds"))

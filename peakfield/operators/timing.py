"""Times of a run: sections, sampled batches and their estimates, rates, and what Spark's own status store tells about the stages of a job group.

Samples of times are rows (section, seconds); a section may be timed in any number of tasks. Null, infinite and negative times, and not-numbers, are no
samples. What is read of Spark's store is a row for each stage, at most as many as spark.ui.retainedStages keeps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import read_result, write_result

T = TypeVar("T")
QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
STAGES = "job int, stage int, name string, tasks int, failed_tasks int, wall_seconds double, run_seconds double, cpu_seconds double, input_rows long, input_bytes long, output_rows long, output_bytes long, shuffle_read_bytes long, shuffle_write_bytes long, spilled_bytes long"


def usable(seconds: Column) -> Column:
    return F.coalesce((seconds >= 0) & (seconds < float("inf")), F.lit(False))


def sections(samples: DataFrame, by: str = "section", seconds: str = "seconds", accuracy: int = 0) -> DataFrame:
    """Count, total, mean, quantiles and extremes of each section's times. Quantiles are exact and lie between samples where need be; a task then holds the
    different times of a section with their counts. With an accuracy they are samples near the quantile, from sketches of bounded size."""
    c = F.col(seconds)
    levels = F.array(*map(F.lit, QUANTILES.values()))
    held = F.percentile_approx(c, levels, accuracy) if accuracy else F.percentile(c, levels)
    rows = samples.where(usable(c)).groupBy(by).agg(F.count("*").alias("count"), F.sum(c).alias("total_seconds"), F.avg(c).alias("mean_seconds"), held.alias("held"), F.min(c).alias("minimum_seconds"), F.max(c).alias("maximum_seconds"))
    quantiles = [F.col("held")[i].alias(f"{name}_seconds") for i, name in enumerate(QUANTILES)]
    return rows.select(by, "count", "total_seconds", "mean_seconds", *quantiles, "minimum_seconds", "maximum_seconds")


def estimated(samples: DataFrame, batches: DataFrame, all_batches: int, batch: str = "batch", by: str = "section", seconds: str = "seconds") -> DataFrame:
    """What sampled sections take over all batches. samples: batch, section and seconds; a section that a batch enters more than once counts with its sum.
    batches: batch and seconds, the whole time of each sampled batch. fraction: the section's mean against that of whole batches (null where that is 0)."""
    own = samples.where(usable(F.col(seconds))).groupBy(batch, by).agg(F.sum(seconds).alias("own"))
    whole = batches.where(usable(F.col(seconds))).agg(F.avg(seconds).alias("whole"))
    rows = own.groupBy(by).agg(F.count("*").alias("samples"), F.avg("own").alias("mean_seconds"), F.max("own").alias("maximum_seconds"))
    # one row: an aggregate without keys
    return rows.join(F.broadcast(whole)).select(by, "samples", "mean_seconds", "maximum_seconds", (F.col("mean_seconds") * all_batches).alias("estimated_seconds"), F.try_divide("mean_seconds", "whole").alias("fraction"))


def rates(wall: Column, orientations: Column, batches: Column, pixels: Column) -> list[Column]:
    """Orientations, batches and pixels of correlation in a second; null where no time has passed, or where there are no pixels for an orientation."""
    per = lambda n: F.when(wall > 0, n.cast("double") / wall)
    return [per(orientations).alias("orientations_per_second"), per(batches).alias("batches_per_second"), F.when(pixels > 0, per(orientations * pixels)).alias("ccf_pixels_per_second")]


def measured(spark: SparkSession, run: Callable[[], T]) -> tuple[T, DataFrame]:
    """What run returns, and the stages of all jobs that it started in this thread. A caller's own job group is set again afterwards, errors included."""
    sc, group = spark.sparkContext, f"measured-{uuid.uuid4().hex}"
    names = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = [sc.getLocalProperty(n) for n in names]
    sc.setJobGroup(group, "measured")
    try:
        out = run()
    finally:
        for n, v in zip(names, before, strict=True):
            sc.setLocalProperty(n, v)
    return out, stages(spark, group)


def stages(spark: SparkSession, group: str) -> DataFrame:
    """The stages of a job group's jobs that ran, each with its last attempt. A stage whose output an earlier job has left is skipped, and no row here; one that
    several jobs name counts for the first."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()  # the store is filled by events, some of which may still be on their way
    tracker, store, seen, rows = sc.statusTracker(), sc._jsc.sc().statusStore(), set(), []
    for job in sorted(tracker.getJobIdsForGroup(group)):
        about = tracker.getJobInfo(job)
        for stage in sorted(about.stageIds if about else []):
            if stage in seen or tracker.getStageInfo(stage) is None:
                continue
            s = store.lastStageAttempt(stage)
            if not (s.submissionTime().isDefined() and s.completionTime().isDefined()):
                continue
            seen.add(stage)
            wall = (s.completionTime().get().getTime() - s.submissionTime().get().getTime()) / 1e3
            sizes = (s.inputRecords(), s.inputBytes(), s.outputRecords(), s.outputBytes(), s.shuffleReadBytes(), s.shuffleWriteBytes(), s.diskBytesSpilled())
            rows.append((job, stage, s.name(), s.numTasks(), s.numFailedTasks(), wall, s.executorRunTime() / 1e3, s.executorCpuTime() / 1e9, *sizes))
    return spark.createDataFrame(rows, STAGES)


def write_report(spark: SparkSession, path: str, samples: DataFrame, batches: DataFrame, all_batches: int, wall: float, orientations: int, pixels: int) -> dict:
    """Sections of all samples, estimates from sampled batches and the samples themselves as one committed result; the rates and counts stand in the commit,
    which is returned. samples: batch (null outside the batches), section, seconds."""
    timed = samples.where("batch is not null")
    per = lambda n: n / wall if wall > 0 else None
    about = {"wall_seconds": wall, "total_batches": all_batches, "total_orientations": orientations, "orientations_per_second": per(orientations), "batches_per_second": per(all_batches), "ccf_pixels_per_second": per(orientations * pixels) if pixels else None}
    tables = {"wall_sections": sections(samples.where("batch is null")), "sections": estimated(timed, batches, all_batches), "batches": timed}
    return write_result(spark, path, tables, about)


def top_sections(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    """The report's longest sections (the top-k report itself), those of whole runs and the estimated ones together."""
    whole = read_result(spark, path, "wall_sections").select("section", F.col("total_seconds").alias("seconds"), F.lit("wall").alias("kind"))
    guessed = read_result(spark, path, "sections").select("section", F.col("estimated_seconds").alias("seconds"), F.lit("estimated").alias("kind"))
    return whole.union(guessed).orderBy(F.desc("seconds"), "section", "kind").limit(k)

"""Sections, estimates, rates and measured stages on small cases; their queries are compared with SQL among the others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfield.operators import timing
from peakfield.sources import commits
from peakfield.sources.files import shared_folder


def test_sections_leave_out_what_is_no_time(spark):
    rows = [("a", x) for x in (1.0, 2.0, 4.0, 8.0)] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("a", -1.0), ("b", 0.0), ("c", None)]
    got = {r.section: r for r in timing.sections(spark.createDataFrame(rows, "section string, seconds double")).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a["count"], a.total_seconds, a.mean_seconds, a.minimum_seconds, a.maximum_seconds) == (4, 15.0, 3.75, 1.0, 8.0)
    assert np.allclose([a.median_seconds, a.p90_seconds, a.p95_seconds, a.p99_seconds], np.percentile([1, 2, 4, 8], [50, 90, 95, 99]))
    near = {r.section: r for r in timing.sections(spark.createDataFrame(rows, "section string, seconds double"), accuracy=1000).collect()}
    assert near["a"].median_seconds in (2.0, 4.0) and near["a"].p99_seconds == 8.0
    assert timing.sections(spark.createDataFrame([], "section string, seconds double")).count() == 0


def test_estimates_add_up_a_batchs_entries(spark):
    samples = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (2, "x", 4.0), (2, "y", 1.0), (3, "y", None)], "batch long, section string, seconds double")
    batches = spark.createDataFrame([(1, 4.0), (2, 8.0)], "batch long, seconds double")
    got = {r.section: tuple(r)[1:] for r in timing.estimated(samples, batches, 100).collect()}
    assert got == {"x": (2, 3.0, 4.0, 300.0, 0.5), "y": (1, 1.0, 1.0, 100.0, 1 / 6)}
    assert {r.fraction for r in timing.estimated(samples, batches.where("false"), 100).collect()} == {None}


def test_rates_without_time_or_pixels_are_null(spark):
    rows = spark.createDataFrame([(2.0, 10, 4, 3), (0.0, 1, 1, 1), (None, 1, 1, 1), (2.0, 10, 4, 0)], "w double, o long, b long, p long")
    assert [tuple(r) for r in rows.select(*timing.rates(*map(F.col, "wobp"))).collect()] == [(5.0, 2.0, 15.0), (None,) * 3, (None,) * 3, (5.0, 2.0, None)]


def test_measured_stages_are_those_of_the_run(spark):
    sc, path = spark.sparkContext, shared_folder(spark, "measured")
    spark.range(1000).count()
    sc.setJobGroup("outer", "the caller's")
    try:
        out, rows = timing.measured(spark, lambda: spark.range(0, 5000, 1, 3).groupBy((F.col("id") % 7).alias("k")).count().collect())
        assert len(out) == 7 and sc.getLocalProperty("spark.jobGroup.id") == "outer"
        got = rows.collect()
        assert len({r.stage for r in got}) == len(got) >= 2 and all(r.failed_tasks == 0 and r.run_seconds >= 0 for r in got)
        assert got[0].tasks == 3 and got[0].shuffle_write_bytes > 0 and sum(r.shuffle_read_bytes for r in got) == sum(r.shuffle_write_bytes for r in got)
        _, written = timing.measured(spark, lambda: spark.range(0, 5000, 1, 3).write.parquet(path))
        assert sum(r.output_rows for r in written.collect()) == 5000
        _, again = timing.measured(spark, lambda: spark.read.parquet(path).where("id >= 0").agg(F.sum("id")).collect())
        assert sum(r.input_rows for r in again.collect()) == 5000
        with pytest.raises(ZeroDivisionError):
            timing.measured(spark, lambda: 1 / 0)
        assert sc.getLocalProperty("spark.jobGroup.id") == "outer"
        assert timing.measured(spark, lambda: 5)[1].count() == 0
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)


def test_a_report_is_one_result(spark):
    samples = spark.createDataFrame([(None, "search", 9.0), (None, "write", 1.0), (0, "fft", 1.0), (1, "fft", 3.0)], "batch long, section string, seconds double")
    batches = spark.createDataFrame([(0, 2.0), (1, 4.0)], "batch long, seconds double")
    path = shared_folder(spark, "timing")
    about = timing.write_report(spark, path, samples, batches, 50, 10.0, 200, 64)
    assert about["orientations_per_second"] == 20.0 and about["ccf_pixels_per_second"] == 1280.0 and about["tables"]["batches"]["rows"] == 2
    assert commits.committed(spark, path) == about
    assert [(r.section, r.seconds, r.kind) for r in timing.top_sections(spark, path, 2).collect()] == [("fft", 100.0, "estimated"), ("search", 9.0, "wall")]
    none = timing.write_report(spark, shared_folder(spark, "timing"), samples, batches, 50, 0.0, 200, 0)
    assert none["batches_per_second"] is None and none["ccf_pixels_per_second"] is None

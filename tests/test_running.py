"""Configurations, batches, stacks, commits, preparations and normal tails on small cases."""

import json
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfield.functions import normal
from peakfield.operators import batch, filters, histogram, paths, peaks, schema, spectral, stages, volumes
from peakfield.sources import commits, prepared, stacks
from peakfield.sources.files import shared_folder


def read(spark, *texts, **more):
    rows = spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "i long, text string")
    return [(r.config, r.errors) for r in schema.read(rows, "text", **more).orderBy("i").collect()]


def test_configurations_have_all_sections_and_defaults(spark):
    (c, errors), = read(spark, {})
    assert errors == [] and c.search.angular_step_deg == 5.0 and c.search.in_plane_step_deg is None and c.template.include_chains == [] and c.output_prefix == "match" and c.search.preserve_psi_360_duplicate is True
    assert set(c.asDict()) == {k for k in schema.sections() if k != "-"} | set(schema.sections()["-"])
    (c, errors), = read(spark, {"search": {"in_plane_step_deg": None, "symmetry": "5"}, "template": {"include_chains": ["A", "B"]}, "debug": {"debug_dir": "x"}})
    assert errors == [] and c.search.symmetry == "5" and c.template.include_chains == ["A", "B"] and c.debug.debug_dir == "x"


def test_configurations_tell_all_errors(spark):
    got = read(spark, None, "", "{", "[1]", "5", {"search": {"pixel_size_angstrom": "abc"}}, {"search": []}, {"nope": 1, "search": {"nope": 2}}, {"search": {"image_slice": 1.5, "allow_rotation_for_speed": 1}}, {"search": {"pixel_size_angstrom": -1}, "runtime": {"first_orientation": 5, "last_orientation": 4}}, {"debug": {"single_orientation_psi_deg": 1}}, {"template": {"include_chains": "A"}}, {"template": {"include_chains": ["A"], "exclude_chains": ["A"]}})
    errors = [e for _, e in got]
    assert errors[:5] == [["no JSON object"]] * 5
    assert errors[5] == ["search.pixel_size_angstrom is no double"] and got[5][0].search.pixel_size_angstrom == 1.0
    assert errors[6] == ["search is no object"] and errors[7] == ["unknown key nope", "unknown key search.nope"]
    assert errors[8] == ["search.allow_rotation_for_speed is no boolean", "search.image_slice is no int"]
    assert errors[9] == ["not runtime.last_orientation is null or runtime.last_orientation >= runtime.first_orientation", "not search.pixel_size_angstrom > 0"]
    assert len(errors[10]) == 1 and errors[11] == ["template.include_chains is no array<string>"] and errors[12] == ["not not arrays_overlap(template.include_chains, template.exclude_chains)"]
    assert read(spark, {}, paths=True)[0][1] == ["not input_mrc != '' or micrographs_star != ''", "not template.source != 'mrc' or template_mrc != ''"]
    (c, e), = read(spark, {"search": {"image_slice": 3}}, overrides={"search.image_slice": F.col("i") + 7, "output_prefix": F.lit(None)})
    assert c.search.image_slice == 7 and c.output_prefix == "match" and e == []
    assert schema.read(spark.createDataFrame([], "text string"), "text").count() == 0


def test_one_failing_job_of_ten(spark):
    jobs = spark.createDataFrame([(i, f"m{i}") for i in range(10)], "index long, name string")
    path, calls = shared_folder(spark, "batch"), shared_folder(spark, "calls")

    def work(job):
        if job["index"] == 4:
            raise RuntimeError("line one\nline two")
        return {"n": len(job["name"]) + job["index"]}

    first = {r["index"]: r for r in batch.run(jobs, work, "n int", path).collect()}
    assert sum(r.status == "ok" for r in first.values()) == 9 and first[4].n is None and first[4].error == "RuntimeError: line one\nline two" and "work" in first[4].traceback
    assert first[7].n == 9 and batch.rollup(batch.run(jobs, work, "n int", path)).first().failed == 1
    with pytest.raises(RuntimeError, match="job 4 failed: RuntimeError: line one"):
        batch.run(jobs, work, "n int", path, continue_on_error=False)
    last = {r["index"]: r for r in batch.run(jobs, lambda job: {"n": 1}, "n int", path).collect()}
    assert last[4].status == "ok" and last[4].attempt == 4 and last[3].attempt == 1 and last[3].n == 5
    assert batch.run(jobs.where("false"), work, "n int", calls).count() == 0
    with pytest.raises(ValueError, match="does not name"):
        batch.run(jobs.union(jobs), work, "n int", path)
    with pytest.raises(ValueError, match="columns"):
        batch.run(jobs.withColumn("Error", F.lit(1)), work, "n int", path)


def test_stacks(spark):
    rows = spark.createDataFrame([(i, i * 2, [float(i)] * 6) for i in (0, 3, 9, 5, 8)], "stack_index long, task long, values array<double>")
    path = shared_folder(spark, "stack")
    assert stacks.write_stack(rows, path, 10, (2, 3), 4) == 5
    assert {(r.stack_index, r.task) for r in stacks.read_index(spark, path).collect()} == {(i, 2 * i) for i in (0, 3, 9, 5, 8)}
    part = stacks.read_stack(spark, path, 4, 8)
    assert {(r.stack_index, r["values"][0]) for r in part.collect()} == {(5, 5.0), (8, 8.0)}
    assert "PartitionFilters: [isnotnull(shard" in part._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="outside"):
        stacks.read_stack(spark, path, 4, 10)
    for bad in ((10, 6), (-1, 6), (1, 5)):
        other = shared_folder(spark, "stack")
        with pytest.raises(Exception, match="outside a stack"):
            stacks.write_stack(spark.createDataFrame([(bad[0], 0, [1.0] * bad[1])], rows.schema), other, 10, (2, 3))
        with pytest.raises(ValueError, match="no committed"):
            stacks.read_stack(spark, other)
    other = shared_folder(spark, "stack")
    with pytest.raises(ValueError, match="more than once"):
        stacks.write_stack(rows.union(rows), other, 10, (2, 3))
    with pytest.raises(ValueError, match="no committed"):
        stacks.read_index(spark, other)


def test_results_show_only_with_their_commit(spark):
    root = shared_folder(spark, "runs")
    t = spark.range(3)
    told = commits.write_result(spark, f"{root}/a", {"x": t, "y": t.where("id > 5")}, {"k": 1})
    assert told["tables"]["x"] == {"columns": ["id"], "rows": 3} and told["tables"]["y"]["rows"] == 0
    t.write.parquet(f"{root}/b/x")
    with pytest.raises(ValueError, match="no committed"):
        commits.read_result(spark, f"{root}/b", "x")
    with pytest.raises(ValueError, match="no table z"):
        commits.read_result(spark, f"{root}/a", "z")
    assert commits.read_result(spark, f"{root}/a", "x").count() == 3
    assert [(r.run, json.loads(r.about)["k"]) for r in commits.results(spark, root).collect()] == [("a", 1)]


def test_prepared_once(spark):
    path = shared_folder(spark, "prepared")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "i long, text string")
    make = lambda new: new.select("entry", F.upper("text").alias("made"))
    got, n = prepared.prepare(rows, "text", {"s": 1, "t": 2}, make, path)
    assert n == 2 and {(r.i, r.made or "") for r in got.collect()} == {(1, "A"), (2, "A"), (3, ""), (4, "")}
    assert prepared.prepare(rows, "text", {"t": 2, "s": 1}, make, path)[1] == 0
    assert prepared.prepare(rows.union(spark.createDataFrame([(5, "new")], rows.schema)), "text", {"t": 2, "s": 1}, make, path)[1] == 1
    assert prepared.prepare(rows, "text", {"t": 2, "s": 2}, make, path)[1] == 2


def test_normal_tails(spark):
    z = [0.0, 0.1, -0.3, 0.66, 0.67, 1.0, -2.0, 5.65, 5.66, 12.5, 22.5, 37.0, -40.0]
    for r in spark.createDataFrame([(v,) for v in z], "z double").select("z", normal.survival("z").alias("t")).collect():
        assert abs(r.t - 0.5 * math.erfc(r.z / math.sqrt(2))) <= 1e-13 * r.t
    p = [0.5, 0.4, 0.6, 0.0243, 0.0242, 1e-3, 1e-9, 1e-20, 1e-100, 1e-300, 0.999, 1 - 1e-12, 0.0, 1.0]
    for r in spark.createDataFrame([(v,) for v in p], "p double").select("p", normal.upper_quantile("p").alias("t")).collect():
        want = -NormalDist().inv_cdf(min(max(r.p, 2.0**-1022), 1 - 2.0**-53))
        assert abs(r.t - want) <= 1e-9 * max(1, abs(want))
    odd = spark.createDataFrame([(None,), (float("nan"),)], "z double").select(normal.survival("z").alias("s"), normal.upper_quantile("z").alias("q")).collect()
    assert odd[0].s is None and odd[0].q is None and math.isnan(odd[1].s)


def test_histogram_report(spark):
    counts = histogram.histogram(spark.createDataFrame([(0.1,), (0.12,), (5.0,)], "z double"), "z")
    rows = histogram.report(counts, F.lit(1000.0), 1.0, 2.0).collect()
    assert len(rows) == 512 and len(rows[0]) == 7 and sum(r.raw_count for r in rows) == 3
    for r in rows:
        assert abs(r.expected_gaussian_survival - 500 * math.erfc(r.snr_midpoint / math.sqrt(2))) < 1e-9 and abs(r.source_curve_x_scaled - (r.snr_midpoint - 1) / 2) < 1e-12


def test_peaks_have_twelve_columns(spark):
    found = spark.createDataFrame([(1, 1, 2, 3, 9.0), (1, 2, 5, 5, 8.0)], "grid long, rank int, x long, y long, score double")
    maps = spark.createDataFrame([(1, 2, 3, *[float(i) for i in range(6)])], "grid long, x long, y long, " + ", ".join(f"{c} double" for c in peaks.LABELS))
    got = {r["rank"]: r for r in peaks.described(found, maps, 1.5).collect()}
    assert len(got[1]) == 13 and (got[1].x_angstrom, got[1].y_angstrom, got[1].psi_deg) == (3.0, 4.5, 3.0) and got[2].phi_deg is None


def test_filters(spark):
    r = np.random.default_rng(4)
    half = r.normal(size=(6, 4))
    row = spark.createDataFrame([(half.ravel().tolist(),)], "f array<double>")
    for size, scale in ((6, 1.0), (4, 1.5), (4, 0.7)):
        got = np.array(row.select(filters.sampled(F.col("f"), 6, size, scale).alias("v")).first().v).reshape(size, size // 2 + 1)
        for y in range(size):
            for x in range(size // 2 + 1):
                u, v = x * scale, (y if y < (size + 1) // 2 else y - size) * scale
                i, j = math.floor(u), math.floor(v)
                want = 0.0
                if i + 1 <= 3 and j >= -3 and j + 1 <= 2 and (x or y):
                    want = sum(half[(j + b) % 6, i + a] * (1 - abs(u - i - a)) * (1 - abs(v - j - b)) for a in (0, 1) for b in (0, 1))
                assert abs(got[y, x] - want) < 1e-12
    one = filters.condition_filter(5, lambda fx, fy: F.lit(2.0), F.array(F.lit(1.0), F.lit(0.0)), [lambda fx, fy: fx + 1, lambda fx, fy: F.lit(0.5)])
    got = np.array(spark.range(1).select(one.alias("v")).first().v).reshape(5, 3)
    f = np.hypot(np.fft.fftfreq(5)[:, None], np.fft.rfftfreq(5)[None])
    want = (1 - f / math.sqrt(0.5)) * (np.fft.rfftfreq(5)[None] + 1)
    want[0, 0] = 0
    assert np.allclose(got, want)
    image, template = filters.weighted_filters(8, lambda fx, fy: F.lit(-0.5), F.lit(2.0), (0.1, 0.2, 0.3), 3.0, 100.0, 5.0, 2.0)
    a, b = (np.array(v).reshape(8, 5) for v in spark.range(1).select(image.alias("a"), template.alias("b")).first())
    assert a[0, 0] == b[0, 0] == 0 and (a >= 0).all() and (b <= 0).all() and b[0, 1] < 0


def test_views_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(volumes, "VIEWS", 2)
    r = np.random.default_rng(1)
    own = spark.createDataFrame([(k, r.normal(size=64).tolist()) for k in (1, 2)], "task long, template array<double>")
    views = spark.createDataFrame([(i, 10.0 * i, 20.0 * i, 5.0 * i) for i in range(5)], "view int, phi double, theta double, psi double")
    one = spark.createDataFrame([(7, [1.0] * 12), (8, [2.0] * 12)], "condition int, filter array<double>")
    plain = {(x.task, x.view): x for x in volumes.slices(own, views, 4).collect()}
    held = volumes.by_view(own, views, 4, spectral.parts, ["re", "im"], conditions=one).collect()
    assert len(plain) == 10 and len(held) == 20
    assert all(np.allclose(np.array(x.re), np.array(plain[x.task, x.view].re) * (x.condition - 6)) for x in held)


def test_paths(spark):
    folder = shared_folder(spark, "listed")
    commits.commit(spark, f"{folder}/a", {})
    assert any(r.path.startswith(folder.removeprefix("file://")) and "metadata.json" in r.path for r in paths.listing(spark, folder).collect())
    given = [("x/../b.mrc", "/r1/b.mrc", True), ("c.mrc", "/r2/c.mrc", True), ("./d.mrc", "/r1/d.mrc", False), ("/abs//e.mrc", "/abs/e.mrc", True), ("../up.mrc", "/up.mrc", False), (None, None, None), ("c.mrc", "/r2/c.mrc", True)]
    files = spark.createDataFrame([("/r1/b.mrc",), ("/r2/b.mrc",), ("/r2/c.mrc",), ("/abs/e.mrc",), ("/abs/e.mrc",)], "path string")
    rows = spark.createDataFrame([(g[0],) for g in given], "p string")
    got = [tuple(r) for r in paths.resolved(rows, "p", files, ["/r1", "/r2/"]).collect()]
    assert sorted(got, key=str) == sorted(given, key=str)


def test_correlation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK_BYTES", 1500)
    r = np.random.default_rng(6)
    images, templates = {f"i{k}": r.normal(size=(4, 4)) for k in range(9)}, {k: r.normal(size=(4, 4)) for k in range(11)}
    templates[10] = templates[3]
    own = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in images.items()], "vec_id string, embedding array<double>")
    tasks = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in templates.items()], "task long, template array<double>")
    got = {(x.vec_id, x.y, x.x): x for x in spectral.correlated(own, tasks, 4).collect()}
    assert len(got) == 9 * 16
    for k, v in images.items():
        score = np.stack([np.round(np.fft.ifft2(np.fft.fft2(v) * np.conj(np.fft.fft2(t))).real / 16, 9) for t in templates.values()])
        for y, x in np.ndindex(4, 4):
            s = score[:, y, x]
            x_ = got[k, y, x]
            assert abs(x_.mip - max(s.max(), 0)) < 1e-8 and x_.n == 11 and abs(x_.s1 - s.sum()) < 1e-7 and x_.task == (int(s.argmax()) if s.max() > 0 else None)
    assert spectral.correlated(own, tasks.where("false"), 4).count() == 0 and spectral.correlated(own.where("false"), tasks, 4).count() == 0


def test_stages_stop_and_go_on(spark):
    path, ran = shared_folder(spark, "stages"), []

    def step(name, k):
        def of(rows):
            ran.append(name)
            return rows.select((F.col("id") * k).alias("id"))

        return name, of

    steps = [step("a", 2), step("b", 3), step("c", 5)]
    assert sorted(r.id for r in stages.run(spark.range(3), steps, path, stop_after=2).collect()) == [0, 6, 12] and ran == ["a", "b"]
    assert [(r.name, r.committed, r.rows) for r in stages.done(spark, path, steps).collect()] == [("a", True, 3), ("b", True, 3), ("c", False, None)]
    spark.range(9).write.parquet(f"{stages.folder(path, 2, 'c')}/rows")  # cut off before its commit
    assert sorted(r.id for r in stages.run(spark.range(0), steps, path).collect()) == [0, 30, 60] and ran == ["a", "b", "c"]
    assert stages.run(spark.range(0), steps, path).count() == 3 and ran == ["a", "b", "c"]
    for bad in ([], [step("a", 1), step("a", 1)]):
        with pytest.raises(ValueError):
            stages.run(spark.range(1), bad, path)
    with pytest.raises(ValueError, match="no stage"):
        stages.run(spark.range(1), steps, path, stop_after=4)

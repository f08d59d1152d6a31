import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfield.operators import filters, volumes
from peakfield.sources import mrc, pdb, templates
from peakfield.sources.files import shared_folder

BOX, PIXEL, RESOLUTION = 12, 2.0, 3.0
GIVEN = {"box": BOX, "pixel": PIXEL, "resolution": RESOLUTION}


def text(rows):
    """Lines of (record, element, chain, x, y, z)."""
    return "\n".join("%-6s%5d  %-3s MOL %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s" % (r, 1, e, c, 1, x, y, z, 1, 0, e) for r, e, c, x, y, z in rows)


ONE = [("ATOM", "C", "A", 1.0, 2.0, 3.0), ("ATOM", "N", "A", -2.5, 0.25, 1.5), ("HETATM", "O", "B", 4.0, -3.0, 0.5), ("ATOM", "ZN", "B", 0.0, 0.0, -2.0), ("TER", "C", "A", 9.0, 9.0, 9.0)]
TWO = [("ATOM", "S", "B", 0.0, 1.0, 2.0)]


def frame(spark, *models):
    return spark.createDataFrame(list(models), "model string, content string")


def centre(rows, het=True):
    own = [(pdb.ELEMENTS.get(e, (0, 0))[1], np.array(at)) for r, e, c, *at in rows if r in (("ATOM", "HETATM") if het else ("ATOM",))]
    return sum(m * v for m, v in own) / sum(m for m, _ in own)


def brute(rows, at, het=True, without=()):
    out, fall = np.zeros((BOX,) * 3), (math.pi / (RESOLUTION / PIXEL)) ** 2
    height, w = (fall / math.pi) ** 1.5, round(RESOLUTION * 3 / PIXEL)
    for r, e, c, *place in rows:
        n = pdb.ELEMENTS.get(e, (0, 0))[0]
        if not n or c in without or r not in (("ATOM", "HETATM") if het else ("ATOM",)):
            continue
        p = ((np.array(place) - at) / PIXEL + BOX / 2)[::-1]
        low, high = np.maximum(np.rint(p - w), 0).astype(int), np.minimum(np.rint(p + w), BOX - 1).astype(int)
        for i in np.ndindex(*np.maximum(high - low, 0)):
            out[tuple(low + i)] += n * height * math.exp(-fall * np.linalg.norm(low + i - p))
    return out


def volume(spark, uri, file):
    rows = mrc.volumes(mrc.read_mrc(spark, f"{uri}/volumes")).where(F.col("file") == file).orderBy("z").collect()
    assert all(abs(r.voxel - PIXEL) < 1e-6 for r in rows)
    return np.array([r["values"] for r in rows]).reshape((BOX,) * 3)


def test_templates_are_made_once(spark):
    uri = shared_folder(spark, "models")
    own = frame(spark, ("one", text(ONE)), ("two", text(TWO)), ("same as one", text(ONE).replace("\n", "\n")))
    found, a, b = templates.templates(own, "content", uri, y_flip=True, **GIVEN)
    rows = {r.model: r for r in found.collect()}
    assert (a, b) == (2, 2) and rows["one"].file == rows["same as one"].file != rows["two"].file
    assert np.allclose(volume(spark, uri, rows["one"].file), brute(ONE, centre(ONE))[:, ::-1], rtol=1e-5, atol=1e-6)
    assert np.allclose(list(rows["one"]["shift"]), -centre(ONE)) and rows["one"].atoms == 4
    assert json.loads(rows["one"].about)["y_flip"] is True
    assert templates.templates(own, "content", uri, y_flip=True, **GIVEN)[1:] == (0, 0)
    # another chain: volumes are made anew about the centre of the whole model
    found, a, b = templates.templates(own, "content", uri, exclude=["B"], **GIVEN)
    rows = {r.model: r for r in found.collect()}
    assert (a, b) == (0, 2) and rows["two"].file is None and rows["two"].error == "no atom is left" and rows["two"].atoms == 0 and list(rows["two"].composition) == []
    assert np.allclose(volume(spark, uri, rows["one"].file), brute(ONE, centre(ONE), without="B"), rtol=1e-5, atol=1e-6)
    assert templates.templates(own, "content", uri, exclude=["B"], **GIVEN)[1:] == (0, 0)
    # other records: the centre is another one
    found, a, b = templates.templates(own, "content", uri, include_hetatm=False, **GIVEN)
    assert (a, b) == (2, 2)
    assert np.allclose(volume(spark, uri, found.where("model = 'one'").first().file), brute(ONE, centre(ONE, False), False), rtol=1e-5, atol=1e-6)
    # a changed model alone is made anew
    changed = frame(spark, ("one", text(ONE)), ("two", text(TWO + ONE[:1])))
    assert templates.templates(changed, "content", uri, y_flip=True, **GIVEN)[1:] == (1, 1)
    with pytest.raises(ValueError):
        templates.templates(own, "content", uri, include=["A"], exclude=["A"], **GIVEN)


def test_centre_files(spark):
    uri = shared_folder(spark, "models")
    own = frame(spark, ("one", text(ONE)), ("none", None), ("bad", "ATOM\nnothing"))
    found, made = templates.centres(own, "content", uri)
    assert made == 3
    row = found.where("model = 'one'").select("*", templates.centre_json(True).alias("json")).first()
    told = json.loads(row.json)
    assert told["pdb_sha256"] == row.sha256 and np.allclose(told["center_angstrom"], centre(ONE))
    assert told["atom_count"] == 4 and told["mass_supported_atom_count"] == 3 and told["chain_counts"] == {"A": 2, "B": 2} and told["element_counts"] == {"C": 1, "N": 1, "O": 1, "ZN": 1}
    assert {(r.model, r.atoms, r.centre) for r in found.where("model != 'one'").collect()} == {("none", 0, None), ("bad", 0, None)}
    texts = [row.json, '{"center_angstrom":[1,2]}', '{"center_angstrom":[1,null,3]}', "no json", "{}", None, '{"center_angstrom":[1,2,3]}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", templates.stated_centre(F.col("t")).alias("c"), templates.is_centre_of(F.col("t"), F.lit(row.sha256), True).alias("own"), templates.is_centre_of(F.col("t"), F.lit(row.sha256), False).alias("other")).orderBy("i").collect()
    assert [r.c.error is None for r in got] == [True, False, False, False, False, False, True] and (got[6].c.x, got[6].c.y, got[6].c.z) == (1, 2, 3)
    assert [r.own for r in got] == [True] + [False] * 6 and not any(r.other for r in got)
    # all models may share a given centre
    found, a, b = templates.templates(own, "content", uri, reference=texts[6], **GIVEN)
    assert (a, b) == (0, 3)
    rows = {r.model: r for r in found.collect()}
    assert np.allclose(volume(spark, uri, rows["one"].file), brute(ONE, np.array([1.0, 2, 3])), rtol=1e-5, atol=1e-6) and rows["none"].error == rows["bad"].error == "no atom is left"
    assert np.allclose(volume(spark, uri, templates.templates(own, "content", uri, center=False, **GIVEN)[0].where("model = 'one'").first().file), brute(ONE, np.zeros(3)), rtol=1e-5, atol=1e-6)
    far = [("ATOM", "C", "A", 500.0, 0.0, 0.0), ("ATOM", "C", "A", -500.0, 0.0, 0.0)]
    row = templates.templates(frame(spark, ("far", text(far))), "content", uri, **GIVEN)[0].first()
    assert row.error is None and not volume(spark, uri, row.file).any()
    for wrong in texts[1:3]:
        with pytest.raises(ValueError):
            templates.templates(own, "content", uri, reference=wrong, **GIVEN)


def test_empty_table_of_models(spark):
    found, a, b = templates.templates(frame(spark).limit(0), "content", shared_folder(spark, "models"), **GIVEN)
    assert (found.count(), a, b) == (0, 0, 0)


@pytest.mark.parametrize("side", [1, 4, 5, 8])
def test_slices_whitened_by_their_own_curves(side):
    rng = np.random.default_rng(side)
    f = rng.normal(size=(3, side, side // 2 + 1)) + 1j * rng.normal(size=(3, side, side // 2 + 1))
    f[1] = 0
    got, want = volumes.self_whitened(f), np.zeros_like(f)
    rings = {(y, x): math.floor(math.hypot(min(y, side - y), x) + 0.5) - 1 for y in range(side) for x in range(side // 2 + 1)}
    for v in range(3):
        for ring in range(max(side // 2, 1)):
            at = [p for p, r in rings.items() if r == ring]
            power = np.mean([abs(f[v][p]) ** 2 for p in at]) if at else 0
            for p in at:
                want[v][p] = f[v][p] / math.sqrt(max(power, 1e-12))
    assert np.allclose(got, want) and not got[:, 0, 0].any() and not got[1].any()


def test_combined_filters(spark):
    row = spark.range(1).select(filters.combined(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-4.0))).alias("w")).first()
    assert list(row.w) == [3.0, -8.0]

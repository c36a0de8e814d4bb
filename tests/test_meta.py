"""Meta-analyses: results by key, errors by column, spaces, clusters."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.functions import coords
from studyloom.meta import Results, run_meta
from studyloom.operators import cbma


def export(folder, columns, shift=0, space="MNI"):
    """An export with three studies; ``columns``: name to the studies that it takes in."""
    out = folder / "outputs"
    out.mkdir(parents=True, exist_ok=True)
    point = lambda s, k: {"id": f"{s}_{k}", "coordinates": [10 + 4 * k + shift, 20, 30], "space": space}
    studies = [{"id": str(s), "analyses": [{"id": f"{s}_analysis_0", "points": [point(s, k) for k in range(0 if s == 2 else 2)]}]} for s in range(3)]
    (out / "nimads_studyset.json").write_text(json.dumps({"id": "x", "studies": studies}))
    notes = [{"analysis": f"{s}_analysis_0", "note": {c: s in own for c, own in columns.items()}} for s in range(3)]
    (out / "nimads_annotation.json").write_text(json.dumps({"id": "a", "note_keys": {c: "boolean" for c in columns}, "notes": notes}))
    return str(folder)


def jobs(spark, run):
    """Spark jobs of the cbma draws and kernels: how often statistics were computed."""
    calls = []
    real = cbma.estimate
    cbma.estimate = lambda *a, **k: calls.append(a[0]) or real(*a, **k)
    try:
        got = run()
    finally:
        cbma.estimate = real
    return got, calls


def test_results_by_key(spark, tmp_path):
    folder = export(tmp_path, {"a": (0, 1), "b": (0,), "none": (2,)})
    top = lambda df: {r["column"]: r["m"] for r in df.groupBy("column").agg(F.max("stat").alias("m")).collect()}
    first, made = jobs(spark, lambda: run_meta(spark, folder))
    assert top(first) == {"a": 2, "b": 1} and made == ["mkdadensity"]
    again, made = jobs(spark, lambda: run_meta(spark, folder))
    assert top(again) == {"a": 2, "b": 1} and made == []
    other, made = jobs(spark, lambda: run_meta(spark, folder, "ale"))
    assert set(top(other)) == {"a", "b"} and max(top(other).values()) < 1 and made == ["ale"]
    assert top(run_meta(spark, folder)) == {"a": 2, "b": 1}
    store = Results(spark, f"{folder}/outputs")
    assert {(r["column"], r["error"]) for r in store.errors().where("estimator = 'ale'").collect()} == {("none", "no coordinates")}
    assert store.index().count() == 4
    # a column's new foci are computed, another column's stay
    export(tmp_path, {"a": (0, 1), "b": (1,), "none": (2,)})
    _, made = jobs(spark, lambda: run_meta(spark, folder))
    assert made == ["mkdadensity"] and store.index().where("estimator = 'mkdadensity'").groupBy("column").count().orderBy("column").collect() == [("a", 1), ("b", 2)]


def test_options_and_errors(spark, tmp_path, monkeypatch):
    folder = export(tmp_path, {"a": (0, 1), "b": (0,), " ": (0,)})
    draws = []
    real = cbma._draws
    monkeypatch.setattr(cbma, "_draws", lambda f, e, n, s: draws.append(n) or real(f, e, n, s))
    done = run_meta(spark, folder, "mkdadensity", "montecarlo", {"n_iters": 50})
    assert draws == [50] and done.agg(F.min("q")).first()[0] >= 1 / 51
    run_meta(spark, folder, "mkdadensity", "montecarlo", {"n_iters": 50})
    assert draws == [50]
    with pytest.raises(TypeError, match="fwhm"):
        run_meta(spark, folder, "mkdadensity", "fdr", {"fwhm": 3})
    with pytest.raises(ValueError, match="no name"):
        run_meta(spark, folder, "kda", fail_fast=True)
    whole = cbma.estimate

    def bad(name, foci, **given):
        if foci.where("column = 'b'").count():
            raise RuntimeError("column b is bad")
        return whole(name, foci, **given)

    monkeypatch.setattr(cbma, "estimate", bad)
    left = run_meta(spark, folder, "kda")
    assert {r["column"] for r in left.select("column").distinct().collect()} == {"a"}
    errors = Results(spark, f"{folder}/outputs").errors().where("estimator = 'kda'").collect()
    assert {(r["column"], r["error"]) for r in errors} == {(" ", "no name"), ("b", "column b is bad")}
    monkeypatch.setattr(cbma, "estimate", whole)
    assert {r["column"] for r in run_meta(spark, folder, "kda").select("column").distinct().collect()} == {"a", "b"}
    assert Results(spark, f"{folder}/outputs").errors().where("estimator = 'kda' and column = 'b'").count() == 0


def test_talairach_foci_are_moved(spark, tmp_path):
    back = np.linalg.inv(np.array(coords.mni_from_tal() + [[0, 0, 0, 1]]))[:3]
    assert np.allclose(back, coords.TAL_FROM_MNI)
    rows = [("a", "1", 10.0, 20.0, 30.0, s) for s in ("TAL", "MNI", None, "other")]
    points = spark.createDataFrame(rows, "analysis_id string, study_id string, x double, y double, z double, space string")
    notes = spark.createDataFrame([("c", "a", True)], "column string, analysis_id string, value boolean")
    got = [(r["x"], r["y"], r["z"]) for r in cbma.slice_foci(points, notes).collect()]
    want = np.array(coords.mni_from_tal()) @ np.array([10, 20, 30, 1])
    assert sum(np.allclose(g, want) for g in got) == 1 and got.count((10.0, 20.0, 30.0)) == 3 and not np.allclose(want, (10, 20, 30), atol=0.5)
    one = run_meta(spark, export(tmp_path / "tal", {"a": (0,)}, space="TAL"))
    two = run_meta(spark, export(tmp_path / "mni", {"a": (0,)}, space="MNI"))
    assert {r["voxel"] for r in one.collect()} != {r["voxel"] for r in two.collect()}


def flood(grid, level):
    """Sizes and masses of face-connected sets, by search."""
    left, found = {tuple(x) for x in np.argwhere(grid >= level)}, []
    while left:
        todo, own = [left.pop()], []
        while todo:
            x = todo.pop()
            own.append(x)
            for axis in range(3):
                for d in (-1, 1):
                    y = tuple(v + d * (k == axis) for k, v in enumerate(x))
                    if y in left:
                        left.remove(y)
                        todo.append(y)
        found.append((len(own), sum(grid[x] - level for x in own)))
    return max((f[0] for f in found), default=0), max((f[1] for f in found), default=0.0)


def test_clusters_of_a_grid():
    rng = np.random.default_rng(0)
    for density in (0.0, 0.1, 0.35, 0.6, 1.0):
        grid = np.where(rng.random((7, 9, 8)) < density, rng.integers(1, 5, (7, 9, 8)), 0).astype(float)
        for level in (1, 2, 4):
            size, mass = cbma.largest_clusters(grid, level)
            want = flood(grid, level)
            assert size == want[0] and mass == pytest.approx(want[1])


def test_cluster_correction(spark):
    rng = random.Random(1)
    spot = [("c", f"u{k}", 2.0, 2.0, 2.0) for k in range(12)]
    rest = [("c", f"v{k}", *(float(rng.randint(o, o + e)) for o, e in zip(cbma.ORIGIN, cbma.EXTENT))) for k in range(12)]
    foci = spark.createDataFrame(spot + rest + [("d", "u", 0.0, 0.0, 0.0)], "column string, unit string, x double, y double, z double")
    tests = cbma.mkda_p(cbma.mkda(foci), foci).cache()
    found = {(r["column"], r["cluster"]): r for r in cbma.montecarlo_clusters(foci, tests, n_iters=20, voxel_p=1e-4).collect()}
    above = tests.where("p < 1e-4").collect()
    grid = np.zeros([e // 4 + 1 for e in cbma.EXTENT])
    for r in above:
        if r["column"] == "c":
            grid[r["voxel"] // 1_000_000, r["voxel"] // 1000 % 1000, r["voxel"] % 1000] = r["stat"]
    level = min(r["stat"] for r in above if r["column"] == "c")
    size, mass = flood(grid, level)
    best = max((r for (c, _), r in found.items() if c == "c"), key=lambda r: r["size"])
    assert (best["size"], best["mass"]) == (size, mass)
    tops = [cbma.largest_clusters(cbma.drawn_map("mkdadensity", [(1, 24)], 4, cbma._generator(0, "c", it)), level) for it in range(1, 21)]
    assert best["q_size"] == pytest.approx((1 + sum(t[0] >= size for t in tops)) / 21) and best["q_mass"] == pytest.approx((1 + sum(t[1] >= mass for t in tops)) / 21)
    both = cbma.correct("montecarlo", foci, tests, n_iters=5, vfwe_only=False, voxel_thresh=1e-4)
    inside = both.where("q_size is not null")
    assert both.count() == tests.count() and inside.count() == len(above)
    assert cbma.montecarlo_clusters(foci, tests.where("p > 2"), n_iters=2).count() == 0

"""Meta-analyses of many foci: the sums of units' maps, and what a task is given."""

import math
import time
from decimal import Decimal, localcontext
from itertools import accumulate

import numpy as np
import pytest

from studyloom.operators import cbma

SCHEMA = "column string, unit string, x double, y double, z double"


def scattered(spark, units, foci, columns=("c",), spread=90):
    rng = np.random.default_rng(2)
    rows = [(c, f"u{u}", *(float(v) for v in rng.integers(-spread, spread, 3))) for c in columns for u in range(units) for _ in range(foci)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("fwhm", [None, 10.0])
def test_sums_of_maps(fwhm):
    """F8, F9: foci alone, in pairs, in crowds, repeated, and units of many foci."""
    from studyloom.operators import grids

    k, rng = cbma._kernel(4, 10.0 if fwhm is None else None, fwhm), np.random.default_rng(1)
    for n, among in ((1, None), (2, 500), (3, None), (12, 3000), (30, None), (64, None), (65, None), (200, 2000)):
        at = k.cells[rng.integers(0, among or len(k.cells), (n, 20))]
        at[-1, :5] = at[0, :5]
        got, want = grids.Map(k), np.zeros(k.places)
        got.add(at)
        for u in at.T:
            near = np.zeros(k.places)
            for o, c in zip(k.offsets, k.of):
                np.maximum.at(near, u + o, k.values[c])
            want += near
        assert np.allclose(got.total(), want[k.cells], atol=1e-9, rtol=0)


def test_draws_of_many_units_are_counted():
    """foci are counted by place, not spread one by one."""
    begun = time.time()
    drawn = cbma.drawn_map("mkdadensity", [(1, 20_000_000), (3, 100_000)], 4, np.random.default_rng(0))
    assert time.time() - begun < 20
    inner = drawn[2:-2, 2:-2, 2:-2].mean()
    assert inner == pytest.approx(81 * 20_300_000 / cbma.grid_size(4), rel=0.01)


def test_draws_of_a_column_are_many_tasks(spark):
    """levels join before the iterations are dealt out, not after."""
    _, foci = scattered(spark, 3, 2)
    levels = spark.createDataFrame([("c", 2.0)], "column string, level double")
    dealt = cbma._draws(foci, "mkdadensity", 100, 4, levels)
    assert "level" in dealt.columns and sum(len(p) > 0 for p in dealt.rdd.glom().collect()) == 4


def test_maps_are_not_rows(spark):
    """F6 to F9: no focus is spread into rows before a shuffle, and mkda_p spreads none."""
    _, foci = scattered(spark, 3, 2)
    stats = cbma.mkda(foci).checkpoint()
    for made in (cbma.mkda(foci), cbma.ale(foci), cbma.mkda_p(stats, foci)):
        assert "_o" not in made._jdf.queryExecution().optimizedPlan().toString().replace("_offset", "").split()
        assert "d2" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert "mapInArrow" not in cbma.mkda_p(stats, foci)._jdf.queryExecution().optimizedPlan().toString()


def test_units_across_batches(spark):
    """a unit whose cells lie in several batches is one unit; several columns."""
    rows, foci = scattered(spark, 4, 3000, ("c", "d", None))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        got = {(r["column"], r["voxel"]): r["stat"] for r in cbma.mkda(foci).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for c, u, *p in rows:
        at = [round((v - o) / 4) for v, o in zip(p, cbma.ORIGIN)]
        if all(0 <= a <= e // 4 for a, e in zip(at, cbma.EXTENT)):
            for a, b, d, _ in cbma.kernel(4):
                near = (at[0] + a, at[1] + b, at[2] + d)
                if all(0 <= v <= e // 4 for v, e in zip(near, cbma.EXTENT)):
                    want.setdefault((c, near[0] * 1_000_000 + near[1] * 1_000 + near[2]), set()).add(u)
    assert got == {k: len(v) for k, v in want.items()}


def test_ale_p_beyond_one(spark):
    """where many units make the statistic 1.0, p still follows their sum."""
    foci = spark.createDataFrame([("c", f"u{u}", 2.0, 2.0, 2.0) for u in range(2000)] + [("c", f"v{u}", 50.0, 2.0, 2.0) for u in range(1000)], SCHEMA)
    stats = cbma.ale(foci)
    got = cbma.ale_p(stats, foci).collect()
    assert len(got) == stats.count() and max(r["stat"] for r in got) == 1.0
    assert all(0 < r["p"] <= 1 and not math.isnan(r["p"]) for r in got)
    assert min(r["p"] for r in got) < 1e-9


def test_tails_of_many_values():
    """all tails of a column come from one sum."""
    k = np.arange(0, 20_000, 3)
    begun = time.time()
    got = cbma.binomial_tails(k, 1_000_000, 0.005)
    assert time.time() - begun < 5 and got[0] == 1 and (np.diff(got) <= 0).all()
    few = cbma.binomial_tails(np.array([0, 3, 7]), 9, 0.3)
    assert few == pytest.approx([sum(math.comb(9, x) * 0.3**x * 0.7 ** (9 - x) for x in range(v, 10)) for v in (0, 3, 7)])
    assert cbma.poisson_tails(np.array([0, 100, 800]), 835.0)[:2] == pytest.approx([1, 1])


@pytest.mark.parametrize("mean", [0.01, 13.3, 800.2, 4801.3])
def test_poisson_tails_keep_their_digits(mean):
    """rounded to nine digits, p-values are those of whole tails in sixty digits, with a
    mean of any size and for statistics far below and above it."""
    with localcontext() as context:
        context.prec = 60
        m, last = Decimal(mean), int(mean + 60 * mean**0.5 + 400)
        terms = [(-m).exp()]
        for x in range(1, last + 1):
            terms.append(terms[-1] * m / x)
        tails = [*accumulate(reversed(terms))][::-1]
    k = np.array([*range(last + 1), 15 * last])
    assert np.abs(cbma.poisson_tails(k, mean) - [*map(float, tails), 0.0]).max() < 1e-13


@pytest.mark.parametrize("name", ["mkdadensity", "ale"])
def test_draws_of_large_units_are_side_by_side(name, monkeypatch):
    """units of many foci, of any sizes, are not spread one at a time; their draws
    are those of each unit on its own."""
    from studyloom.operators import grids

    sizes, k = [(n, 7) for n in range(70, 150, 5)] + [(900, 70)], cbma._kernel(4, *((None, 10.0) if name == "ale" else (10.0, None)))
    rng, want = np.random.default_rng(3), np.zeros(k.places)
    for n, units in sizes:
        for first in range(0, units, grids.TOGETHER):
            for u in k.cells[rng.integers(0, len(k.cells), (n, min(grids.TOGETHER, units - first)), np.int32)].T:
                place, of = k._union(u)
                want[place] += k.values[of]
    alone, union = [], grids.Kernel._union
    monkeypatch.setattr(grids.Kernel, "_union", lambda k, place: alone.append(1) or union(k, place))
    got = cbma.drawn_map(name, sizes, 4, np.random.default_rng(3)).ravel()
    assert len(alone) < 20  # the last few
    assert np.allclose(got, 1 - np.exp(-want[k.cells]) if name == "ale" else want[k.cells], atol=1e-9, rtol=0)


def test_rows_of_large_units():
    """units of more than the limit come together, filled up with a row of their own."""
    from studyloom.operators import grids

    sizes = np.array([3, 70, 2, 900, 66, 3, 70])
    first = np.cumsum(sizes) - sizes
    seen = []
    for own, at in grids.by_size(first, sizes, 64, 3):
        seen += own.tolist()
        assert len(own) <= 3
        for u, rows in zip(own, at.T):
            assert np.array_equal(np.unique(rows), np.arange(first[u], first[u] + sizes[u]))
    assert sorted(seen) == list(range(7))


def test_clusters_of_a_full_grid():
    """draws above the level nearly everywhere are labelled at once, not pair by pair."""
    shape, rng = [e // 4 + 1 for e in cbma.EXTENT], np.random.default_rng(4)
    begun = time.time()
    for _ in range(20):
        grid = rng.integers(1, 4, shape).astype(float)
        assert cbma.largest_clusters(grid, 1.0) == (grid.size, float((grid - 1).sum()))
    assert time.time() - begun < 4
    ring = np.zeros((5, 5, 5))
    ring[0], ring[1:, 0, 0], ring[4, :, 4], ring[4, 0, :], ring[2, 2, 2] = 1, 1, 2, 2, 9
    assert cbma.largest_clusters(ring, 1.0) == (25 + 4 + 8, 9.0)


@pytest.mark.parametrize("batch", [7, 700])
def test_repeated_foci_are_told_by_order(spark, batch):
    """F8, F9: rows are sorted, not held in a hash map; repeats across batches go, and
    the last unit held back is whole."""
    rows, _ = scattered(spark, 5, 400, ("c", None), 9)
    rows += [("d", None, 0.0, 0.0, 0.0)] * 1500 + [("d", "u", 0.0, 0.0, 0.0)] * 3
    foci = spark.createDataFrame(rows, SCHEMA)
    plan = cbma.mkda(foci)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    cells, want = {}, {}
    for c, u, *p in rows:
        cells.setdefault((c, u), set()).add(tuple(round((v - o) / 4) for v, o in zip(p, cbma.ORIGIN)))
    for (c, _), own in cells.items():
        for v in {(i + a, j + b, k + d) for i, j, k in own for a, b, d, _ in cbma.kernel(4)}:
            at = c, v[0] * 1_000_000 + v[1] * 1_000 + v[2]
            want[at] = want.get(at, 0) + 1
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r["column"], r["voxel"]): r["stat"] for r in cbma.mkda(foci).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == want


@pytest.mark.parametrize("name", ["mkda_p_values", "ale_p_values"])
def test_foci_are_read_once(spark, monkeypatch, name):
    """statistic, units and histograms come from one reading of the foci, and are
    what the functions of one statistic each give."""
    from studyloom.plans import catalogue

    rows, foci = scattered(spark, 40, 5, ("c", None))
    rows += [("d", None, 0.0, 0.0, 0.0), ("d", "far", 900.0, 0.0, 0.0), *[("d", "many", 4.0 * n - 80, 4.0 * n - 100, 8.0) for n in range(40)] * 3]
    foci = spark.createDataFrame(rows, SCHEMA)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    monkeypatch.setattr(catalogue, "_foci", lambda *_: foci.mapInPandas(counted, SCHEMA))
    got = {(r["column"], r["voxel"]): (r["stat"], r["p"]) for r in catalogue.queries()[name](spark, "").collect()}
    assert read.value == len(rows)
    one = cbma.mkda_p(cbma.mkda(foci), foci) if name == "mkda_p_values" else cbma.ale_p(cbma.ale(foci), foci)
    want = {(r["column"], r["voxel"]): (r["stat"], r["p"]) for r in one.collect()}
    assert got.keys() == want.keys() and {c for c, _ in got} == {"c", "d"}
    assert np.allclose(list(got.values()), [want[k] for k in got], atol=1e-9, rtol=0)

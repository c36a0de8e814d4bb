"""Coordinate-based meta-analysis as DataFrame programs over all columns at once.

Foci have (column, unit, x, y, z) in mm. They are put on a grid, dealt out by unit
and sorted, and repeated voxels of a unit are passed over. A task sums the maps of its units
on one grid a column (``grids.py``), and these are added by (column, voxel): what is
shuffled is a row a focus and a grid a task, not a row a voxel of a unit. The voxel
key packs i, j, k.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.coords import to_mni
from studyloom.operators import grids
from studyloom.session import checkpoints

#: Least corner of the grid in mm, and its size.
ORIGIN = (-90, -126, -72)
EXTENT = (180, 216, 180)
RADIUS = 10.0
FWHM = 10.0
#: Steps up to the largest -log(1 - activation) in the null distribution of ALE, and its least bins.
STEPS, BINS = 256, 8192


def voxel(i: Column, j: Column, k: Column) -> Column:
    return i.cast("long") * 1_000_000 + j.cast("long") * 1_000 + k.cast("long")


def on_grid(foci: DataFrame, step: int) -> DataFrame:
    """Foci with grid indexes i, j, k; those outside the grid or not finite go. The
    indexes come out of a generator, so that the test of them is not pushed below it,
    where each use would work out the coordinates (text, in some sources) again."""
    index = [F.bround((F.col(c) - o) / step).try_cast("int").alias(n) for c, o, n in zip("xyz", ORIGIN, "ijk")]
    return _inside(foci.select("*", F.inline(F.array(F.struct(*index)))), step)


def _inside(df: DataFrame, step: int) -> DataFrame:
    test = F.lit(True)
    for n, e in zip("ijk", EXTENT):
        test = test & F.col(n).between(0, e // step)
    return df.where(test)


def kernel(step: int, radius: float = RADIUS) -> list[tuple[int, int, int, float]]:
    """(di, dj, dk, d2) of a ball; d2 is the squared distance in mm."""
    n = int(radius // step)
    span = range(-n, n + 1)
    return [(a, b, c, float((a * a + b * b + c * c) * step * step)) for a in span for b in span for c in span if (a * a + b * b + c * c) * step * step <= radius * radius]


def spread(cells: DataFrame, step: int, radius: float = RADIUS) -> DataFrame:
    """Cells at every offset of the kernel (515 rows at most on a 2 mm grid, so it
    is carried as an array literal and no row is shuffled for it)."""
    rows = kernel(step, radius)
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(d).alias("d2")) for a, b, c, d in rows])
    moved = cells.withColumn("_o", F.explode(offsets))
    kept = [c for c in cells.columns if c not in "ijk"]
    moved = moved.select(*kept, (F.col("i") + F.col("_o.a")).alias("i"), (F.col("j") + F.col("_o.b")).alias("j"), (F.col("k") + F.col("_o.c")).alias("k"), F.col("_o.d2").alias("d2"))
    return _inside(moved, step).withColumn("voxel", voxel(F.col("i"), F.col("j"), F.col("k")))


def grid_size(step: int) -> int:
    """Voxels of the grid."""
    return math.prod(e // step + 1 for e in EXTENT)


def _cells(foci: DataFrame, step: int) -> DataFrame:
    """Voxels of each unit, sorted. Units are dealt out here, while rows are few; what is
    spread from them afterwards stays where it is. Equal voxels are told by the order
    (``_whole_units``), so no task holds its rows in a hash map."""
    cells = on_grid(foci, step).select("column", "unit", voxel(F.col("i"), F.col("j"), F.col("k")).alias("cell"))
    return cells.repartition("column", "unit").sortWithinPartitions("column", "unit", "cell")


@lru_cache(8)
def _kernel(step: int, radius: float | None, fwhm: float | None, steps: int | None = None) -> grids.Kernel:
    """The kernel of a ball, or of a Gaussian as -log(1 - activation), in whole numbers
    up to ``steps`` if that is given; kept by a process."""
    shape = [e // step + 1 for e in EXTENT]
    if fwhm is None:
        return grids.Kernel(shape, kernel(step, radius), np.ones_like)
    sigma2, top, reach = gaussian(step, fwhm)

    def values(d2: np.ndarray) -> np.ndarray:
        found = -np.log1p(-np.minimum(0.999999, top * np.exp(-d2 / (2 * sigma2))))
        return found if steps is None else np.maximum(1, np.rint(found / found[0] * steps))

    return grids.Kernel(shape, kernel(step, reach), values)


def _whole_units(batches):
    """(column, first, sizes, rows) of rows sorted by column, unit and cell, some whole
    units of a column at a time: each unit's first row and number of rows. Repeated cells
    are left out, so a unit has a row a voxel at most, and what is held back is bounded
    by the grid."""
    held: list[pa.RecordBatch] = []
    came = 0

    def parts(rows: pa.Table, last: bool):
        codes = [rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("column", "unit")]
        new = [np.r_[True, c[1:] != c[:-1]] for c in codes]
        cell = rows.column("cell").to_numpy()
        fresh = new[0] | new[1] | np.r_[True, cell[1:] != cell[:-1]]
        if not fresh.all():
            rows, new = rows.filter(pa.array(fresh)), [c[fresh] for c in new]
        starts = np.flatnonzero(new[0] | new[1])
        ends = np.r_[starts[1:], rows.num_rows] if last else starts[1:]
        runs = np.flatnonzero(new[0][starts[: len(ends)]])
        for x, y in zip(runs, np.r_[runs[1:], len(ends)]):
            yield rows["column"][int(starts[x])].as_py(), starts[x:y], ends[x:y] - starts[x:y], rows
        held[:] = [] if last else rows.slice(int(starts[-1])).to_batches()

    for batch in batches:
        held.append(batch)
        came += batch.num_rows
        if came >= grids.DRAWN:
            came = 0
            yield from parts(pa.Table.from_batches(held), False)
    if sum(b.num_rows for b in held):
        yield from parts(pa.Table.from_batches(held), True)


def _unit_cells(batches, k: grids.Kernel, together: int = grids.TOGETHER):
    """(column, rows, at) of sorted cells: units of equal numbers of cells, or of many,
    (n, units) places, with the rows of the input that they are, and that input."""
    for column, first, sizes, rows in _whole_units(batches):
        cell = rows.column("cell").to_numpy()
        places = k.place(cell // 1_000_000, cell // 1_000 % 1_000, cell % 1_000)
        for _, at in grids.by_size(first, sizes, k.limit, together):
            yield column, rows, at, places[at]


def _summed(foci: DataFrame, step: int, radius: float | None, fwhm: float | None) -> DataFrame:
    """(column, voxel, stat, n): the sum of the units' maps, n null, and at voxel null the
    number of units; a task has one grid, that of the column at hand."""
    kind = dict(foci.dtypes)["column"]

    def run(batches):
        k = _kernel(step, radius, fwhm)
        own = made = arrow = None
        units = 0
        for column, table, _, places in _unit_cells(batches, k, grids.LANES):
            if made is None or column != own:
                if made is not None:
                    yield _grid_rows(own, arrow, units, made)
                own, made, arrow, units = column, grids.Map(k), table.schema.field("column").type, 0
            made.add(places)
            units += places.shape[1]
        if made is not None:
            yield _grid_rows(own, arrow, units, made)

    return _cells(foci, step).mapInArrow(run, f"column {kind}, voxel long, stat double, n long").groupBy("column", "voxel").agg(F.sum("stat").alias("stat"), F.sum("n").alias("n"))


def _grid_rows(column, kind: pa.DataType, units: int, *maps: grids.Map) -> pa.RecordBatch:
    """A row a voxel that the first map reaches, with the sums of all maps, and a row of
    the units' number."""
    k = maps[0].kernel
    at = np.stack(np.unravel_index(np.arange(len(k.cells)), k.shape), 1) @ np.array([1_000_000, 1_000, 1])
    totals = [m.total() for m in maps]
    some = np.flatnonzero(totals[0] > k.values.min() / 2)
    more = lambda x, last, of: pa.concat_arrays([pa.array(x, of), pa.array([last], of)])
    sums = [more(t[some], None, pa.float64()) for t in totals]
    names = ["stat", *[f"stat{i}" for i in range(1, len(maps))]]
    return pa.RecordBatch.from_arrays([pa.array([column] * (len(some) + 1), kind), more(at[some], None, pa.int64()), *sums, pa.array([None] * len(some) + [units], pa.int64())], ["column", "voxel", *names, "n"])


def _statistic(sums: DataFrame, stat: Column) -> DataFrame:
    return sums.where("voxel is not null").select("column", "voxel", stat.alias("stat"))


def mkda(foci: DataFrame, step: int = 4, radius: float = RADIUS) -> DataFrame:
    """(column, voxel, stat): units with a focus within ``radius``."""
    return _statistic(_summed(foci, step, radius, None), F.col("stat").cast("long"))


def kda(foci: DataFrame, step: int = 4, radius: float = RADIUS) -> DataFrame:
    """(column, voxel, stat): foci within ``radius``, counted before they are spread."""
    cells = on_grid(foci, step).groupBy("column", "i", "j", "k").agg(F.count("*").alias("n"))
    return spread(cells, step, radius).groupBy("column", "voxel").agg(F.sum("n").alias("stat"))


def gaussian(step: int, fwhm: float) -> tuple[float, float, float]:
    """Variance, peak and radius of the kernel: it ends at three deviations, where it
    has 1% of its peak."""
    sigma2 = (fwhm / (2 * math.sqrt(2 * math.log(2)))) ** 2
    return sigma2, step**3 / (2 * math.pi * sigma2) ** 1.5, 3 * math.sqrt(sigma2)


def ale(foci: DataFrame, step: int = 4, fwhm: float = FWHM) -> DataFrame:
    """(column, voxel, stat): 1 - product over units of (1 - activation), where a
    unit's activation is the largest Gaussian value of its foci."""
    return _statistic(_summed(foci, step, None, fwhm), 1 - F.exp(-F.col("stat")))


ESTIMATORS = {"mkdadensity": mkda, "kda": kda, "ale": ale}
# Options of the interface, and what they are called here; None is accepted
# and changes nothing (n_iters is the corrector's).
OPTIONS = {"kernel__r": "radius", "kernel__fwhm": "fwhm", "r": "radius", "fwhm": "fwhm", "radius": "radius", "n_iters": None, "n_cores": None, "null_method": None, "memory": None, "memory_level": None, "generate_description": None}
CORRECTOR_OPTIONS = {"n_iters": "n_iters", "seed": "seed", "vfwe_only": "vfwe_only", "voxel_thresh": "voxel_p", "voxel_p": "voxel_p", "alpha": None, "method": None, "n_cores": None}
#: Options that each estimator has.
TAKES = {"mkdadensity": ("radius",), "kda": ("radius",), "ale": ("fwhm",)}


def options(name: str, given: dict) -> dict:
    """Options of an estimator under the names that the functions here have; an option
    that it doesn't have is an error that names it."""
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator: {name}")
    named = {}
    for k, v in given.items():
        if k not in OPTIONS or OPTIONS[k] not in (None, *TAKES[name]):
            raise TypeError(f"{name} has no option {k}")
        named[OPTIONS[k]] = v
    named.pop(None, None)
    return named


def corrector_options(name: str, given: dict) -> dict:
    """Options of a corrector; those of an estimator are passed over."""
    if name not in CORRECTORS:
        raise ValueError(f"unknown corrector: {name}")
    named = {}
    for k, v in given.items():
        if k not in CORRECTOR_OPTIONS and k not in OPTIONS:
            raise TypeError(f"{name} has no option {k}")
        named[CORRECTOR_OPTIONS.get(k)] = v
    named.pop(None, None)
    return named if name == "montecarlo" else {}


def estimate(name: str, foci: DataFrame, **given) -> DataFrame:
    step = {k: given.pop(k) for k in ("step",) if k in given}
    return ESTIMATORS[name](foci, **step, **options(name, given)) if name in ESTIMATORS else options(name, given)


def _log_factorials(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v + 1) for v in x.tolist()])


def binomial_tails(k: np.ndarray, n: int, p: float) -> np.ndarray:
    """Probability of k or more of n, for all ``k`` from one sum that starts at its end."""
    if p <= 0 or p >= 1:
        return np.where(k <= 0, 1.0, float(p >= 1))
    most = min(n, int(max(k.max(), n * p) + 40 * math.sqrt(n * p * (1 - p)) + 200))
    x = np.arange(max(0, k.min()), most + 1)
    terms = math.lgamma(n + 1) - _log_factorials(x) - _log_factorials(n - x)
    tails = np.cumsum(np.exp(terms + x * math.log(p) + (n - x) * math.log1p(-p))[::-1])[::-1]
    return np.where(k <= 0, 1.0, np.minimum(1.0, tails[np.maximum(k, x[0]) - x[0]]))


def poisson_tails(k: np.ndarray, mean: float) -> np.ndarray:
    """Probability of k or more events, for all ``k``. Terms follow from each other,
    outward from the largest, and are divided by their sum: their logarithms would lose
    digits with large means."""
    reach = 40 * math.sqrt(mean) + 200
    first, mode, last = max(0, int(mean - reach)), int(mean), int(max(k.max(), mean) + reach)
    below = np.cumprod(np.arange(mode, first, -1) / mean)[::-1]
    terms = np.concatenate([below, [1.0], np.cumprod(mean / np.arange(mode + 1, last + 1))])
    tails = np.cumsum(terms[::-1])[::-1]
    return np.where(k <= first, 1.0, np.minimum(1.0, tails[np.maximum(k, first) - first] / tails[0]))


def _kept(rows: DataFrame) -> DataFrame:
    """Rows of a grid for each column, written once where they are read several times."""
    checkpoints(rows.sparkSession)
    return rows.checkpoint()


def _tails(stats: DataFrame, facts: DataFrame, tail) -> DataFrame:
    """Adds ``p``, worked out once for each distinct statistic of a column. ``facts``
    has one row for each column."""
    values = stats.select("column", "stat").distinct().join(facts, "column")

    def run(batches):
        for rows in batches:
            for _, own in rows.groupby("column"):
                yield pd.DataFrame({"column": own["column"], "stat": own["stat"], "p": tail(own["stat"].to_numpy(), own.iloc[0])})

    kind = dict(stats.dtypes)["column"]
    made = values.mapInPandas(run, f"column {kind}, stat long, p double")
    return stats.join(made, ["column", "stat"]).select(*stats.columns, "p")


def mkda_tests(foci: DataFrame, step: int = 4, radius: float = RADIUS) -> DataFrame:
    """(column, voxel, stat, p): ``mkda`` and ``mkda_p`` by one reading of the foci."""
    sums = _kept(_summed(foci, step, radius, None))
    facts = sums.groupBy("column").agg(F.sum("stat").alias("filled"), F.sum("n").alias("units"))
    return _binomial(_statistic(sums, F.col("stat").cast("long")), facts, step)


def _binomial(stats: DataFrame, facts: DataFrame, step: int) -> DataFrame:
    size = grid_size(step)
    return _tails(stats, facts, lambda k, r: binomial_tails(k, int(r["units"]), r["filled"] / r["units"] / size))


def mkda_p(stats: DataFrame, foci: DataFrame, step: int = 4, radius: float = RADIUS) -> DataFrame:
    """Adds ``p``: the tail of a binomial over units, whose rate is the mean share of
    the grid that a unit's map covers."""
    stats = _kept(stats)
    filled = stats.groupBy("column").agg(F.sum("stat").alias("filled"))  # every voxel of a unit's map counts once in a statistic
    units = on_grid(foci, step).select("column", "unit").distinct().groupBy("column").agg(F.count("*").alias("units"))
    return _binomial(stats, filled.join(units, "column"), step)


def kda_p(stats: DataFrame, foci: DataFrame, step: int = 4, radius: float = RADIUS) -> DataFrame:
    """Adds ``p``: the tail of a Poisson distribution whose mean is the mean count over
    the grid."""
    stats = _kept(stats)
    facts = stats.groupBy("column").agg(F.sum("stat").alias("foci"))
    size = grid_size(step)
    return _tails(stats, facts, lambda k, r: poisson_tails(k, r["foci"] / size))


def _sums_and_histograms(foci: DataFrame, step: int, fwhm: float) -> DataFrame:
    """Two kinds of rows of one reading: (column, voxel, stat, whole) with the sum of the
    units' maps, and of these in whole steps; (column, cells, n) with how many voxels of a
    unit's map have each value of the kernel, and how many units have the same numbers."""
    kind = dict(foci.dtypes)["column"]

    def run(batches):
        k, whole = _kernel(step, None, fwhm), _kernel(step, None, fwhm, STEPS)
        classes = len(k.values)
        around = np.zeros((k.places, classes), np.int32)
        for o, c in zip(k.offsets.tolist(), k.of.tolist()):
            around[k.cells, c] += k.inside[k.cells + o]
        own = maps = arrow = None

        def sums() -> pa.RecordBatch:
            rows = _grid_rows(own, arrow, 0, *maps)
            return batch(*(rows.column(c).slice(0, rows.num_rows - 1) for c in ("column", "voxel", "stat", "stat1")))

        def batch(column, voxel=None, stat=None, steps=None, cells=None, n=None) -> pa.RecordBatch:
            given = {"voxel": (voxel, pa.int64()), "stat": (stat, pa.float64()), "whole": (steps, pa.float64()), "cells": (cells, pa.list_(pa.int32())), "n": (n, pa.int64())}
            return pa.RecordBatch.from_arrays([column, *[pa.nulls(len(column), t) if x is None else x for x, t in given.values()]], ["column", *given])

        for column, table, _, at in _unit_cells(batches, k):
            if maps is None or column != own:
                if maps is not None:
                    yield sums()
                own, maps, arrow = column, [grids.Map(k), grids.Map(whole)], table.schema.field("column").type
            pieces = alone, (focus, shared, low), (unit, place, of) = k.pieces(at)
            for m in maps:
                m.put(at, pieces)
            found = (around[at.ravel()] * alone[:, None]).reshape(*at.shape, classes).sum(0)
            for where, spot, c, sign in ((focus % at.shape[1], shared, low, -1), (unit, place, of, 1)):
                inner = k.inside[spot]
                found += sign * np.bincount(where[inner] * classes + c[inner], minlength=found.size).reshape(found.shape)
            cells, n = np.unique(found, axis=0, return_counts=True)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel().astype(np.int32)), classes).cast(pa.list_(pa.int32()))
            yield batch(pa.array([column] * len(n), arrow), cells=lists, n=pa.array(n))
        if maps is not None:
            yield sums()

    made = _cells(foci, step).mapInArrow(run, f"column {kind}, voxel long, stat double, whole double, cells array<int>, n long")
    return made.groupBy("column", "voxel", "cells").agg(F.sum("stat").alias("stat"), F.sum("whole").cast("long").alias("whole"), F.sum("n").alias("n"))


def ale_p(stats: DataFrame, foci: DataFrame, step: int = 4, fwhm: float = FWHM) -> DataFrame:
    """Adds ``p`` of ``ale_tests``."""
    found = ale_tests(foci, step, fwhm).select("column", "voxel", "p")
    return stats.join(found, ["column", "voxel"]).select(*stats.columns, "p")


def ale_tests(foci: DataFrame, step: int = 4, fwhm: float = FWHM) -> DataFrame:
    """(column, voxel, stat, p): ``ale``, and the share of a null distribution at or above
    the statistic, by one reading of the foci.

    With l = -log(1 - activation), units add up; here l is a whole number of STEPS up to
    the kernel's peak, in the voxels' own sums as in the null, so large sums neither
    reach the end of the doubles near 1 nor drift from the null. A unit's l at a random
    voxel has the histogram of its map, and the null is the convolution of all these.
    Their Fourier transforms are multiplied, as sums of logarithms, once for units with
    equal histograms, at the frequencies where the product can exceed exp(-60). The
    transforms' rounding leaves some 1e-12 of noise; 1e-15 is the least value given."""
    size, kind = grid_size(step), dict(foci.dtypes)["column"]
    kept = _kept(_sums_and_histograms(foci.where("column is not null"), step, fwhm))  # a null equals no column
    sums, units = kept.where("voxel is not null"), kept.where("voxel is null").select("column", "cells", "n")
    values = _kernel(step, None, fwhm, STEPS).values
    covered = F.aggregate("cells", F.lit(0), lambda x, y: x + y)
    facts = units.groupBy("column").agg(F.array(*[F.sum(F.col("n") * F.col("cells")[c] * (size - covered) / size / size) for c in range(len(values))]).alias("rates"))
    bins, used = {}, {}
    for r in facts.join(sums.groupBy("column").agg(F.max("whole").alias("top")), "column").collect():  # a row a column
        n = bins[r["column"]] = max(BINS, 1 << math.ceil(math.log2(1.5 * r["top"])))
        some = []
        for first in range(0, n // 2 + 1, 65536):
            k = np.arange(first, min(first + 65536, n // 2 + 1))
            some.append(k[sum(a * (1 - np.cos(2 * np.pi * k * v / n)) for a, v in zip(r["rates"], values)) < 60])
        used[r["column"]] = np.concatenate(some)

    def factors(cells: np.ndarray, wave: np.ndarray) -> np.ndarray:
        return 1 + cells @ wave.real + 1j * (cells @ wave.imag)

    def transforms(batches):
        own = total = None
        for batch in batches:
            for column, rows in batch.to_pandas().groupby("column", sort=False):
                if total is None or column != own:
                    if total is not None:
                        yield made(own, total)
                    own, total = column, 0
                    wave = np.exp(-2j * np.pi * (used[own] * values[:, None] % bins[own]) / bins[own]) - 1
                cells, n = np.stack(rows["cells"]) / size, rows["n"].to_numpy(float)
                some = np.flatnonzero(n > 4)
                few = np.repeat(np.flatnonzero(n <= 4), rows["n"][n <= 4])  # multiplied first: a logarithm takes longer
                for x in range(0, len(some), 32):
                    total = total + n[some[x : x + 32]] @ np.log(factors(cells[some[x : x + 32]], wave) + 1e-300)
                for x in range(0, len(few), 32):
                    total = total + np.log(factors(cells[few[x : x + 32]], wave).prod(0) + 1e-300)
        if total is not None:
            yield made(own, total)

    def made(column, total) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(pd.DataFrame({"column": column, "k": used[column], "re": total.real, "im": total.imag}), preserve_index=False)

    def nulls(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"column": [], "whole": [], "p": []})
        n = bins[rows["column"].iloc[0]]
        wave = np.zeros(n // 2 + 1, complex)
        wave[rows["k"]] = np.exp(rows["re"].to_numpy() + 1j * rows["im"].to_numpy())
        tail = np.cumsum(np.clip(np.fft.irfft(wave, n), 0, None)[::-1])[::-1]
        return pd.DataFrame({"column": asked["column"], "whole": asked["whole"], "p": np.clip(tail[asked["whole"]], 1e-15, 1)})

    tasks = int(foci.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(tasks, "column", "cells").sortWithinPartitions("column")
    parts = dealt.mapInArrow(transforms, f"column {kind}, k long, re double, im double").groupBy("column", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    null = parts.groupBy("column").cogroup(sums.select("column", "whole").distinct().groupBy("column")).applyInPandas(nulls, f"column {kind}, whole long, p double")
    return sums.join(null, ["column", "whole"]).select("column", "voxel", (1 - F.exp(-F.col("stat"))).alias("stat"), "p")


P_VALUES = {"mkdadensity": mkda_p, "kda": kda_p, "ale": ale_p}


def p_values(name: str, stats: DataFrame, foci: DataFrame, step: int = 4, **given) -> DataFrame:
    """``stats`` of the estimator with ``p`` of its own null distribution."""
    return P_VALUES[name](stats, foci, step, **options(name, given))


def fdr(tests: DataFrame, p: str = "p", by: tuple[str, ...] = ("column",), n: int | None = None) -> DataFrame:
    """Adds ``q`` of Benjamini and Hochberg within each group of ``n`` tests: all rows
    of the group if it is not given, else those that are not listed have p = 1. Equal
    p-values are counted first, so ranks are summed over distinct values, not over
    tests."""
    keys = list(by)
    values = tests.groupBy(*keys, p).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    up = group.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_rank", F.sum("_c").over(up)).withColumn("_n", F.sum("_c").over(group) if n is None else F.lit(n))
    down = group.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down)))
    return tests.join(q.select(*keys, p, "q"), [*keys, p])


def bonferroni(tests: DataFrame, p: str = "p", by: tuple[str, ...] = ("column",), n: int | None = None) -> DataFrame:
    """Adds ``q``: p times the number of tests of the group, or ``n``, 1 at most."""
    if n is not None:
        return tests.withColumn("q", F.least(F.lit(1.0), F.col(p) * n))
    counts = tests.groupBy(*by).agg(F.count("*").alias("_n"))
    return tests.join(counts, list(by)).withColumn("q", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")


def drawn_map(name: str, sizes: list[tuple[int, int]], step: int, rng: np.random.Generator, radius: float = RADIUS, fwhm: float = FWHM) -> np.ndarray:
    """The statistic on the grid after foci are drawn at random for units of ``sizes``
    (foci of a unit, units). Units are drawn some at a time onto one grid, so memory
    does not grow with them, and most of their foci are only counted by place; units of
    one focus are counts of the grid's voxels, drawn as such if they are many."""
    k = _kernel(step, None, fwhm) if name == "ale" else _kernel(step, radius, None)
    made, cells = grids.Map(k), len(k.cells)
    waiting, units_waiting = [], 0
    if name == "kda":  # foci of a unit don't meet
        sizes = [(1, sum(n * units for n, units in sizes))]
    for n, units in sizes:
        if n == 1 and units > 4 * cells:
            made.counts[k.cells] += rng.multinomial(units, np.full(cells, 1 / cells))
            continue
        each = max(1, grids.DRAWN // n) if n <= k.limit else grids.TOGETHER
        for first in range(0, units, each):
            at = k.cells[rng.integers(0, cells, (n, min(each, units - first)), np.int32)]
            if n <= k.limit:
                made.add(at)
                continue
            if waiting and (units_waiting + at.shape[1] > grids.LANES or n * (units_waiting + at.shape[1]) > grids.BESIDE):
                made.add(grids.side_by_side(waiting))
                waiting, units_waiting = [], 0
            waiting.append(at)
            units_waiting += at.shape[1]
    if waiting:
        made.add(grids.side_by_side(waiting))
    total = made.total()
    return (1 - np.exp(-total) if name == "ale" else total).reshape(k.shape)


def largest(name: str, sizes: list[tuple[int, int]], step: int, rng: np.random.Generator, **given) -> float:
    """The largest statistic of a draw."""
    return float(drawn_map(name, sizes, step, rng, **given).max())


def largest_clusters(grid: np.ndarray, level: float) -> tuple[int, float]:
    """Most voxels and largest mass, the sum of what exceeds ``level``, of the
    face-connected sets of voxels at or above it; zeros if there are none.

    Voxels in a row are one run; runs that touch take the least of their roots, all at
    once, until none differ."""
    above = grid >= level
    if not above.any():
        return 0, 0.0
    edge = np.diff(above.astype(np.int8), axis=2, prepend=0)
    run = np.zeros(grid.shape, np.int64)
    run[above] = np.cumsum(edge[above] == 1) - 1
    n = int(run[above].max()) + 1
    pairs = []
    for a, b in ((np.s_[:-1], np.s_[1:]), (np.s_[:, :-1], np.s_[:, 1:])):
        both = above[a] & above[b]
        pair = np.stack((run[a][both], run[b][both]))
        pairs.append(pair[:, np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(0)][: pair.shape[1]]])
    ends, root = np.concatenate(pairs, 1), np.arange(n)
    while ends.shape[1]:
        low, high = np.sort(root[ends], 0)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        ends = ends[:, root[ends[0]] != root[ends[1]]]
    of = root[run[above]]
    return int(np.bincount(of).max()), float(np.bincount(of, grid[above] - level).max())




def _draws(foci: DataFrame, estimator: str, n_iters: int, step: int, facts: DataFrame | None = None) -> DataFrame:
    """(column, sizes, it): a row for each column and iteration. Places are drawn at
    random, so an iteration depends on nothing but how many units have how many foci:
    that table, of one row for each number, is what the tasks get. ``facts`` adds a row
    a column before iterations are dealt out."""
    cells = on_grid(foci, step).select("column", "unit", "i", "j", "k")
    per_unit = (cells if estimator == "kda" else cells.distinct()).groupBy("column", "unit").agg(F.count("*").alias("n"))
    sizes = per_unit.groupBy("column", "n").agg(F.count("*").alias("units")).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("n", "units"))).alias("sizes"))
    sizes = _kept(sizes if facts is None else sizes.join(facts, "column"))
    tasks = int(foci.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sizes.withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(n_iters)))).repartition(tasks, "column", "it")


def _generator(seed: int, column, it: int) -> np.random.Generator:
    """Draws of a column and iteration, so a task that runs again draws the same places."""
    return np.random.default_rng([seed, zlib.crc32(str(column).encode()), int(it)])


def _pairs(sizes) -> list[tuple[int, int]]:
    return [(int(s["n"]), int(s["units"])) for s in sizes]


def montecarlo(foci: DataFrame, stats: DataFrame, estimator: str = "mkdadensity", n_iters: int = 1000, step: int = 4, seed: int = 0, **given) -> DataFrame:
    """Adds ``q``: the share of iterations, this one counted, whose largest statistic
    reaches the observed one."""
    named = options(estimator, given)

    def run(batches):
        for rows in batches:
            tops = [largest(estimator, _pairs(sizes), step, _generator(seed, column, it), **named) for column, sizes, it in zip(rows["column"], rows["sizes"], rows["it"])]
            yield pd.DataFrame({"column": rows["column"], "top": tops})

    kind = dict(stats.dtypes)["column"]
    tops = _draws(foci, estimator, n_iters, step).mapInPandas(run, f"column {kind}, top double").groupBy("column").agg(F.collect_list("top").alias("tops"))
    stats = _kept(stats)
    at_least = F.size(F.filter("tops", lambda t: t >= F.col("stat")))
    values = stats.select("column", "stat").distinct().join(tops, "column").select("column", "stat", ((1 + at_least) / (1 + F.size("tops"))).alias("q"))
    return stats.join(values, ["column", "stat"]).select(*stats.columns, "q")


def montecarlo_clusters(foci: DataFrame, tests: DataFrame, estimator: str = "mkdadensity", n_iters: int = 1000, step: int = 4, seed: int = 0, voxel_p: float = 0.001, **given) -> DataFrame:
    """(column, cluster, size, mass, q_size, q_mass) of the clusters of voxels whose ``p``
    in ``tests`` is below ``voxel_p``. ``mass`` sums what their statistics exceed the
    least of them by; the q are shares of iterations, this one counted, with a cluster
    as large. A column without such voxels has no rows."""
    named = options(estimator, given)
    above = _kept(tests.where(F.col("p") < voxel_p))
    levels = above.groupBy("column").agg(F.min("stat").cast("double").alias("level"))  # a row a column

    def run(batches):
        for rows in batches:
            tops = [largest_clusters(drawn_map(estimator, _pairs(sizes), step, _generator(seed, column, it), **named), level) for column, sizes, it, level in zip(rows["column"], rows["sizes"], rows["it"], rows["level"])]
            yield pd.DataFrame({"column": rows["column"], "size": [t[0] for t in tops], "mass": [t[1] for t in tops]})

    kind = dict(tests.dtypes)["column"]
    drawn = _draws(foci, estimator, n_iters, step, levels).mapInPandas(run, f"column {kind}, size long, mass double")
    null = drawn.groupBy("column").agg(F.collect_list("size").alias("sizes"), F.collect_list("mass").alias("masses"))
    named_voxels = above.join(clusters(above), ["column", "voxel"]).join(levels, "column")
    found = named_voxels.groupBy("column", "cluster").agg(F.count("*").alias("size"), F.sum(F.col("stat") - F.col("level")).alias("mass"))
    share = lambda all_, own: (1 + F.size(F.filter(all_, lambda t: t >= F.col(own)))) / (1 + F.size(all_))
    return found.join(null, "column").select("column", "cluster", "size", "mass", share("sizes", "size").alias("q_size"), share("masses", "mass").alias("q_mass"))


CORRECTORS = ("fdr", "montecarlo", "bonferroni")


def correct(name: str, foci: DataFrame, stats: DataFrame, step: int = 4, estimator: str = "mkdadensity", estimator_args: dict | None = None, **given) -> DataFrame:
    """Statistics with corrected ``q``. fdr and bonferroni need ``p`` in ``stats`` and
    count every voxel of the grid as a test; montecarlo draws with the estimator, and
    with ``vfwe_only=False`` adds ``q_size`` and ``q_mass`` of each voxel's cluster,
    null outside of clusters."""
    if name == "fdr":
        return fdr(stats, n=grid_size(step))
    if name == "bonferroni":
        return bonferroni(stats, n=grid_size(step))
    known, own = corrector_options(name, given), estimator_args or {}
    draw = {k: v for k, v in known.items() if k in ("n_iters", "seed")}
    done = montecarlo(foci, stats, estimator, step=step, **draw, **own)
    if known.get("vfwe_only", True):
        return done
    tests = stats if "p" in stats.columns else p_values(estimator, stats, foci, step, **own)
    level = {k: v for k, v in known.items() if k == "voxel_p"}
    found = montecarlo_clusters(foci, tests, estimator, step=step, **draw, **level, **own)
    of = clusters(tests.where(F.col("p") < level.get("voxel_p", 0.001))).join(found, ["column", "cluster"]).select("column", "voxel", "q_size", "q_mass")
    return done.join(of, ["column", "voxel"], "left")


def clusters(voxels: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(column, voxel, cluster): face-connected sets of voxels, named by the least
    voxel. A round takes the least label around a voxel and then that label's own
    label, so the rounds grow with the logarithm of a cluster's width; each ends in
    a checkpoint."""
    checkpoints(voxels.sparkSession)
    labels = voxels.select("column", "voxel").distinct().withColumn("cluster", F.col("voxel")).checkpoint()
    steps = F.array(*[F.lit(d) for d in (0, 1, -1, 1_000, -1_000, 1_000_000, -1_000_000)])
    mark = None
    for _ in range(max_rounds):
        sent = labels.select("column", F.explode(F.transform(steps, lambda d: F.col("voxel") + d)).alias("voxel"), "cluster").groupBy("column", "voxel").agg(F.min("cluster").alias("new"))
        near = labels.join(sent, ["column", "voxel"]).select("column", "voxel", "cluster", "new")
        # a label's root hears of the least label among its members
        roots = near.groupBy("column", "cluster").agg(F.min("new").alias("root"))
        labels = near.join(roots, ["column", "cluster"]).select("column", "voxel", F.least("new", "root").alias("cluster"))
        up = labels.select("column", F.col("voxel").alias("cluster"), F.col("cluster").alias("up"))
        labels = labels.join(up, ["column", "cluster"]).select("column", "voxel", F.col("up").alias("cluster")).checkpoint()
        now = tuple(labels.agg(F.count("*"), F.sum("cluster")).first())
        if now == mark:
            return labels
        mark = now
    raise RuntimeError("clusters did not settle")


def focus_counter(foci: DataFrame, significant: DataFrame, step: int = 4) -> DataFrame:
    """(column, cluster, unit, n): foci of each unit that lie in a cluster."""
    placed = on_grid(foci, step).withColumn("voxel", voxel(F.col("i"), F.col("j"), F.col("k")))
    return placed.join(clusters(significant), ["column", "voxel"]).groupBy("column", "cluster", "unit").agg(F.count("*").alias("n"))


def skipped(points: DataFrame, notes: DataFrame) -> DataFrame:
    """(column, analyses, skipped): analyses with a true note, and those among them
    without a point of three finite coordinates."""
    wanted = notes.where("value and analysis_id <> ''").select("column", "analysis_id").distinct()
    sound = points.where(" and ".join(f"abs({c}) < double('infinity')" for c in "xyz")).select("analysis_id", F.lit(True).alias("_sound")).distinct()
    return wanted.join(sound, "analysis_id", "left").groupBy("column").agg(F.count("*").alias("analyses"), F.count_if(F.col("_sound").isNull()).alias("skipped"))


def slice_foci(points: DataFrame, notes: DataFrame, include_ids: DataFrame | None = None) -> DataFrame:
    """Foci of every column: points (analysis_id, study_id, x, y, z) of the analyses
    whose note (column, analysis_id, value) is true and whose study is listed. If points
    have a ``space``, Talairach ones are moved to MNI space."""
    wanted = notes.where("value and analysis_id <> ''").select("column", "analysis_id").distinct()
    rows = points if include_ids is None else points.join(include_ids.select(F.col("id").alias("study_id")).distinct(), "study_id", "left_semi")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    at = to_mni(x, y, z, F.col("space")) if "space" in points.columns else [x, y, z]
    return rows.join(wanted, "analysis_id").select("column", F.col("analysis_id").alias("unit"), "study_id", *[v.alias(c) for c, v in zip("xyz", at)])

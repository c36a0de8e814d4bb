"""Meta-analyses of an export, kept by what they were made of.

A result belongs to a column's foci, the estimator, the corrector and their options:
a digest of these is its key. What has a key is not computed again, and another
estimator stands beside the first. What goes wrong is a relation of errors by column.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.operators import cbma
from studyloom.sources import files

INDEX = "key string, column string, estimator string, corrector string, options string, stats string, clusters string, made_at timestamp"
ERRORS = "column string, estimator string, corrector string, error string, at timestamp"


def fingerprints(foci: DataFrame) -> dict[str, str]:
    """A digest of each column's foci, whatever their order; one row a column."""
    h = F.xxhash64("unit", "x", "y", "z")
    rows = foci.groupBy("column").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).collect()
    return {r["column"]: f"{r['n']}:{r['s']}:{r['x']}" for r in rows}


class Results:
    """Statistics and focus counts below ``root``, found by key through an index."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def index(self) -> DataFrame:
        path = f"{self.root}/meta_index"
        return self.spark.read.schema(INDEX).parquet(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], INDEX)

    def have(self, keys: list[str]) -> dict[str, tuple[str, str]]:
        """Folders of statistics and clusters of those ``keys`` that are there."""
        return {r["key"]: (r["stats"], r["clusters"]) for r in self.index().where(F.col("key").isin(keys)).collect()}

    def add(self, keys: dict[str, str], stats: DataFrame, clusters: Callable[[DataFrame], DataFrame], about: tuple[str, str, str]) -> None:
        """Write the statistics of the columns in ``keys``, then their clusters from what
        was written. They count from the index row on, which comes last."""
        name = uuid.uuid4().hex
        places = f"{self.root}/meta/{name}", f"{self.root}/meta_clusters/{name}"
        key = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
        stats.withColumn("key", key[F.col("column")]).write.parquet(places[0])
        done = self.spark.read.parquet(places[0])
        clusters(done).withColumn("key", key[F.col("column")]).write.parquet(places[1])
        rows = [(k, column, *about, *places) for column, k in keys.items()]
        made = self.spark.createDataFrame(rows, INDEX.rsplit(",", 1)[0]).withColumn("made_at", F.current_timestamp())
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/meta_index")

    def stats(self, keys: list[str], which: int = 0) -> DataFrame | None:
        """Rows of ``keys``: statistics, or clusters with 1."""
        places = sorted({p[which] for p in self.have(keys).values()})
        return self.spark.read.parquet(*places).where(F.col("key").isin(keys)).drop("key") if places else None

    def errors(self) -> DataFrame:
        path = f"{self.root}/meta_errors"
        return self.spark.read.schema(f"{ERRORS}, config string").parquet(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], f"{ERRORS}, config string")

    def set_errors(self, found: dict[str | None, str], config: str, about: tuple[str, str]) -> None:
        """The errors of a configuration's last run; those of others stay."""
        rows = self.spark.createDataFrame([(c, *about, e) for c, e in found.items()], ERRORS.rsplit(",", 1)[0]).withColumn("at", F.current_timestamp())
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/meta_errors/config={config}")


def outputs_of(folder: str) -> str:
    """The folder of outputs: the given one, or the one in a run's folder."""
    return folder.rstrip("/") if Path(folder).name == "outputs" else f"{folder.rstrip('/')}/outputs"


def run_meta(
    spark: SparkSession, folder: str, estimator: str = "mkdadensity", corrector: str = "fdr", estimator_args: dict | None = None, corrector_args: dict | None = None, ids: DataFrame | None = None, step: int = 4, fail_fast: bool = False
) -> DataFrame:
    """Statistics (column, voxel, stat, p but for montecarlo, q) of every boolean column
    of an export. The folder may be the run's or its outputs.

    All columns are one job. If it fails, each is tried alone, and those that fail are
    rows of ``meta_errors``, as are columns without a name or without foci; with
    ``fail_fast`` the first error is raised. Unknown options are an error at once."""
    root = outputs_of(folder)
    store = Results(spark, root)
    points, notes = files.nimads(spark, root)
    foci = cbma.slice_foci(points, notes, ids)
    counts = cbma.skipped(points, notes)
    counts.write.mode("overwrite").parquet(f"{root}/meta_skipped")
    first, second = cbma.options(estimator, estimator_args or {}), cbma.corrector_options(corrector, {**(estimator_args or {}), **(corrector_args or {})})
    options = json.dumps([first, second, step], sort_keys=True)
    config = hashlib.sha256(json.dumps([estimator, corrector, options]).encode()).hexdigest()[:16]
    prints = fingerprints(foci)
    errors: dict[str | None, str] = {}

    def failed(column: str | None, error: str) -> None:
        if fail_fast:
            raise ValueError(f"{column}: {error}")
        errors[column] = error

    for r in counts.collect():  # a row a column
        if r["column"] is None or not r["column"].strip():
            failed(r["column"], "no name")
        elif r["column"] not in prints:
            failed(r["column"], "no coordinates")
    keys = {c: hashlib.sha256(f"{config}|{c}|{f}".encode()).hexdigest() for c, f in prints.items() if c is not None and c.strip()}
    have = store.have(list(keys.values()))
    todo = {c: k for c, k in keys.items() if k not in have}

    def compute(some: dict[str, str]) -> None:
        own = foci.where(F.col("column").isin(list(some)))
        stats = cbma.estimate(estimator, own, step=step, **first)
        if corrector in ("fdr", "bonferroni"):
            stats = cbma.p_values(estimator, stats, own, step, **first)
        done = cbma.correct(corrector, own, stats, step, estimator, first, **second)
        level = float((corrector_args or {}).get("alpha", 0.05))
        store.add(some, done, lambda made: cbma.focus_counter(own, made.where(F.col("q") < level), step), (estimator, corrector, options))

    if todo:
        try:
            compute(todo)
        except Exception:
            if fail_fast:
                raise
            for column, key in todo.items():
                try:
                    compute({column: key})
                except Exception as e:  # the others go on
                    errors[column] = str(e)[:1000]
    store.set_errors(errors, config, (estimator, corrector))
    made = store.stats(list(keys.values()))
    return made if made is not None else spark.createDataFrame([], "column string, voxel long, stat double, q double")

"""Incremental results: arriving rows are merged into a table by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from studyloom.operators.relational import last_by, upsert
from studyloom.sources.sinks import _fs, new_version


def merge_batch(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the last row of each key of a batch replaces the
    table's. A batch that is run again gives the same table."""

    def run(batch: DataFrame, _: int) -> None:
        new = last_by(batch, keys, order)
        _sc, place, fs = _fs(batch, path)
        if fs.exists(place):
            old = batch.sparkSession.read.parquet(path)
            newest = last_by(old.unionByName(new, allowMissingColumns=True), keys, order)
            new_version(newest, path)
        else:
            new_version(upsert(new.limit(0), new, keys), path)

    return run


def stream_upserts(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Start merging a stream of screening or annotation results into ``path``; what
    is there to read is taken once."""
    return rows.writeStream.foreachBatch(merge_batch(path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(rows: DataFrame, time: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Results by type and window of arrival; rows later than ``late`` are dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), "screening_type").agg(F.count("*").alias("n"))

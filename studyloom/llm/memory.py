"""Giving memory back between batches, and keeping batches small.

A Python worker serves one stage after the other, and what it has freed stays
with the allocators; with a JVM beside it that can exceed an executor's share.
A batch lies in memory some five times: in the JVM's vectors on the way out and
back, and in the worker as input, parts and result.
"""

from __future__ import annotations

import ctypes
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession

#: Most rows and bytes of a batch of whole texts that goes to a Python worker; a
#: longer text is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to trim
        return None


def trim() -> None:
    """Return freed memory of Arrow and the C library to the system."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Set BATCH for the session from now on, but for limits that it sets itself.
    Batches bound memory only, no result depends on them."""
    own = spark.conf.getAll
    for name, most in BATCH.items():
        if name not in own:
            spark.conf.set(name, most)


@contextmanager
def batches_of(spark: SparkSession):
    """BATCH for what is run inside; the session's own limits hold again behind it."""
    before = {name: spark.conf.getAll.get(name) for name in BATCH}
    small_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

"""A folder of CSV files that change together.

A merge writes every file's new version into a folder of its own and then replaces
``manifest.json``, which names the current version of each file. Until that one
rename readers see the old set whole, whatever has been written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from studyloom.operators.retrieval import merge_csv
from studyloom.sources import files, sinks

MANIFEST = "manifest.json"


def manifest(spark: SparkSession, folder: str) -> dict[str, str]:
    """File name to the place of its current version below ``folder``; empty without one."""
    path = f"{folder.rstrip('/')}/{MANIFEST}"
    return json.loads(spark.read.text(path, wholetext=True).first()["value"]) if files.exists(spark, path) else {}


def member(spark: SparkSession, folder: str, name: str) -> str:
    """Path of a file's current version."""
    root = folder.rstrip("/")
    return f"{root}/{manifest(spark, root).get(name, name)}"


def members(spark: SparkSession, folder: str) -> list[str]:
    """Names of the set's CSV files; a set has a handful."""
    jvm, root = spark.sparkContext._jvm, folder.rstrip("/")
    place = jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted({n for n in listed if n.endswith(".csv")} | set(manifest(spark, root)))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return files.csv(spark, member(spark, folder, name))


def merge(spark: SparkSession, folder: str, new: str, key: str = "pmcid") -> dict[str, str]:
    """Merge the set ``new`` into ``folder``: in each file the new rows take the place
    of all rows with their key; rows without one are appended, and a file that one
    side lacks is the other's. Returns the new manifest."""
    root, version = folder.rstrip("/"), f"versions/{uuid.uuid4().hex}"
    have, come = members(spark, root), members(spark, new)
    current = dict(manifest(spark, root))
    for name in come:
        rows = read(spark, new, name)
        if name in have:
            rows = merge_csv(read(spark, root, name), rows, key)
        sinks.csv_file(rows, f"{root}/{version}/{name}")
        current[name] = f"{version}/{name}"
    sinks.document(spark.createDataFrame([(json.dumps(current, sort_keys=True),)], "value string"), f"{root}/{MANIFEST}")
    return current

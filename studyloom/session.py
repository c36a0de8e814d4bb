"""Session factory with the settings every query of this library assumes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: ANSI casts raise unless ``try_cast`` is used, map merges keep the right side,
#: JSON exports keep nulls, and timestamps are UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.jsonGenerator.ignoreNullFields": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "studyloom", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map={**SETTINGS, **more}).getOrCreate()


def checkpoints(spark: SparkSession) -> None:
    """See that the session has a folder for checkpoints: the shared one that the
    cluster names; a temporary one where it names none, on a local master only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="studyloom-"))

"""The folder that driver and executors share, and what is written there.

On a cluster the folder is the one in ``spark.checkpoint.dir``. Where that
setting is absent, as in tests on a local master, a temporary folder is used;
with any other master its absence is an error, since executors would not see
the driver's disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Root of the shared folder; also sets Spark's checkpoint folder if unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        option = sc._jsc.sc().getCheckpointDir()
        root = option.get() if option.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="studyloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: Paths that this process has written, in order.
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, under this application's own, that nobody has used."""
    path = f"{shared_root(spark)}/studyloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage
    that a lost executor cannot take with it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables have been written so far: a mark for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete the tables written after the mark ``since``, all of this process or, with
    ``but_last``, all but the last one. Frames that read them end with them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _WRITTEN[since : len(_WRITTEN) - 1 if but_last else len(_WRITTEN)]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _WRITTEN[since:] = _WRITTEN[since + len(gone) :]


def with_columns(df: DataFrame, made: dict) -> DataFrame:
    """``df`` with the columns of ``made`` added at its end; columns of ``df``
    with those names, in any case, give way."""
    taken = {k.lower() for k in made}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in made.items()])


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """The rows of ``df`` as one struct ``row``, beside ``more``: names that an operator
    gives to its own columns can't meet those of ``df``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)


def unpacked(columns: list[str], *but: str) -> list[Column]:
    """The columns of ``row``, without those named in ``but``, in any case."""
    return [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in but]

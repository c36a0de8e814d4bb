"""Sinks. The working store is Parquet; JSON and CSV are exports.

An export that is one file is put together from parts that Spark has written in
order, as streams, so neither a row, a task nor the driver holds it. It is written
beside its place and renamed through Hadoop's file system, which also reaches
remote stores.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    sc = df.sparkSession.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return sc, place, place.getFileSystem(sc._jsc.hadoopConfiguration())


def _replace(df: DataFrame, source, place) -> None:
    """Put a file in the place of another in one step."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = df.sparkSession.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
    context.rename(source, place, how)
    # exports may be edited by hand, which a local checksum would not bear
    checksum = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.crc")
    place.getFileSystem(conf).delete(checksum, False)


def document(df: DataFrame, path: str) -> None:
    """The value of a frame of one row and one column as a file. What was there before stays
    until the new file is whole."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    df.toDF("value").select(F.col("value").cast("string")).coalesce(1).write.text(tmp)
    sc, place, fs = _fs(df, path)
    part = next(s.getPath() for s in fs.listStatus(sc._jvm.org.apache.hadoop.fs.Path(tmp)) if s.getPath().getName().startswith("part-"))
    _replace(df, fs.makeQualified(part), fs.makeQualified(place))
    fs.delete(sc._jvm.org.apache.hadoop.fs.Path(tmp), True)


def _items(df: DataFrame, order: list[Column], columns: list[str], keep_nulls: bool = True) -> DataFrame:
    """Rows in order as JSON objects, a comma before each."""
    nulls = {"ignoreNullFields": str(not keep_nulls).lower()}
    return df.orderBy(*order).select(F.concat(F.lit(","), F.to_json(F.struct(*columns), nulls)).alias("value"))


def nested(df: DataFrame, name: str | None, path: str, order: list[str], keep_nulls: bool = True) -> None:
    """``{name: [rows], timestamp}`` with rows in order, or the list alone."""
    rows = _items(df, [F.asc_nulls_first(c) for c in order], df.columns, keep_nulls)
    now = df.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    head, tail = ("[", "]") if name is None else (f'{{"{name}": [', f'], "timestamp": "{now}"}}')
    streamed(rows, path, head, tail + "\n", 1)


def enclosed(df: DataFrame, facts: dict[str, Any], name: str, path: str, order: list[Column], columns: list[str], as_list: bool = False) -> None:
    """``facts`` with the rows of ``df`` (``columns`` of it) in order as the list
    ``name``, or a list of that one object."""
    head, tail = json.dumps({**facts, name: []})[:-2], "]}"
    streamed(_items(df, order, columns), path, f"[{head}" if as_list else head, f"{tail}]\n" if as_list else f"{tail}\n", 1)


def streamed(rows: DataFrame, path: str, head: str, tail: str, skip: int = 0, kind: str = "text", **options: str) -> None:
    """One file of ``head``, the lines of ``rows`` in order but for the first ``skip``
    bytes, and ``tail``. What was there before stays until the new file is whole."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    rows.write.format(kind).options(**options).save(f"{tmp}/rows")
    sc, place, fs = _fs(rows, path)
    jvm = sc._jvm
    whole = jvm.org.apache.hadoop.fs.Path(f"{tmp}/whole")
    listed = ((int(s.getPath().getName().split("-")[1]), s.getPath()) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{tmp}/rows")) if s.getLen() and s.getPath().getName().startswith("part-"))
    parts = sorted(listed, key=lambda p: p[0])
    out = fs.create(whole, True)
    try:
        out.write(bytearray(head.encode()))
        for k, (_, part) in enumerate(parts):
            source = fs.open(part)
            try:
                source.seek(skip if k == 0 else 0)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, sc._jsc.hadoopConfiguration(), False)
            finally:
                source.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    _replace(rows, fs.makeQualified(whole), fs.makeQualified(place))
    fs.delete(jvm.org.apache.hadoop.fs.Path(tmp), True)


def json_row(df: DataFrame, path: str, as_list: bool = False) -> None:
    """A one-row frame as a JSON object, or as a list of one; nulls are written."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    document(df.select(F.concat(F.lit("["), text, F.lit("]")) if as_list else text), path)


def csv_file(df: DataFrame, path: str) -> None:
    """One CSV file in the frame's order, booleans as True and False, quotes doubled."""
    made = df.select(*[F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])
    streamed(made, path, ",".join(df.columns) + "\n", "", kind="csv", escape='"')


def by_table(parsed: DataFrame, path: str) -> None:
    """Parsed tables (table_id, payload: JSON) below ``tables/table_id=...``, and all of
    them in ``all_results.json``, one object by its format. A table has one payload, the
    greatest of several; one without any has null."""
    rows = parsed.groupBy("table_id").agg(F.coalesce(F.max("payload"), F.lit("null")).alias("value"))
    rows.write.mode("overwrite").partitionBy("table_id").text(f"{path}/tables")
    key = F.regexp_replace(F.to_json(F.array("table_id")), r"^\[|\]$", "")
    items = rows.where("table_id is not null").orderBy("table_id").select(F.concat(F.lit(","), key, F.lit(": "), "value").alias("value"))
    streamed(items, f"{path}/all_results.json", "{", "}\n", 1)


def lines(df: DataFrame, column: str, path: str) -> None:
    """One column, in its order, a value on each line; nulls go."""
    rows = df.select(F.col(column).cast("string").alias("value")).where("value is not null").orderBy("value")
    streamed(rows, path, "", "")


def new_version(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table that ``df`` may itself read: the new version is
    written beside it, then takes its place. The old one is put aside under ``.old``
    until that is done; ``recover`` brings it back after a crash in between."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(tmp)
    sc, place, fs = _fs(df, path)
    old = sc._jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    if fs.exists(place):
        fs.delete(old, True)
        fs.rename(place, old)
    fs.rename(sc._jvm.org.apache.hadoop.fs.Path(tmp), place)
    fs.delete(old, True)


def recover(spark, path: str) -> bool:
    """Whether the table is there; one that a crash has left aside is put back."""
    jvm = spark.sparkContext._jvm
    place, old = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place) and fs.exists(old):
        fs.rename(old, place)
    return fs.exists(place)

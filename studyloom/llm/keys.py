"""Joins of a corpus with a narrow verdict that leave most texts where they are.

The hashes of the verdict's keys set bits of a bitmap. Rows of the corpus whose
bit is not set have no verdict: they pass without a join. Only the others are
dealt out and joined exactly, so the bitmap decides how much is moved, never
what is found. It has BITS_A_KEY bits for each key, MOST_BITS at most (8 MB), so
it can be broadcast whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.storage import packed, unpacked

BITS_A_KEY = 32
MOST_BITS = 1 << 26
#: Bits of one binary value; fixed by Spark's bitmap functions.
_CELL = 1 << 15
#: Stands for a null id where ids are joined.
NO_ID = -(2**63)
_BITS, _AT, MAY = "__key_bits", "__key_cell", "__key_may"


def key_hash(id_: Column, mark: Column) -> Column:
    """Hash of an id, which may be null, and of the hash of the row's text."""
    return F.xxhash64(F.coalesce(id_.cast("long"), F.lit(NO_ID)), mark)


def mark_of(text: Column) -> Column:
    """A hash of a text, never null: keeps rows of one id apart unless they are equal."""
    return F.xxhash64(text)


def bitmap(keys: DataFrame, hash_: Column) -> tuple[DataFrame, int]:
    """(cell, bits) of the hashes of ``keys``, and how many bits there are."""
    n = keys.count()
    size = min(MOST_BITS, max(_CELL, 1 << math.ceil(math.log2(max(1, n) * BITS_A_KEY))))
    place = F.pmod(hash_, F.lit(size)) + 1
    cells = keys.select(F.bitmap_bucket_number(place).alias(_AT), F.bitmap_bit_position(place).alias("p"))
    return cells.groupBy(_AT).agg(F.bitmap_construct_agg("p").alias(_BITS)), size


def flagged(rows: DataFrame, hash_: Column, keys: DataFrame, key: Column) -> DataFrame:
    """``rows`` with a boolean column ``__key_may``: false where no key has the row's hash.
    Columns of ``rows`` must not begin with ``__key_``."""
    cells, size = bitmap(keys, key)
    place = F.pmod(hash_, F.lit(size)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(_BITS, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn(_AT, F.bitmap_bucket_number(place))
    joined = placed.join(F.broadcast(cells), _AT, "left")
    may = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn(MAY, may).drop(_AT, _BITS)


def split(docs: DataFrame, keys: DataFrame, id_col: str, mark: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that have no key in ``keys`` (doc_id, mark) for certain, and
    the others: (row, id, mark, hash), with the row as a struct."""
    rows = packed(docs, F.col(id_col).alias("id"), mark.alias("mark"))
    rows = rows.withColumn("hash", key_hash(F.col("id"), F.col("mark")))
    rows = flagged(rows, F.col("hash"), keys, key_hash(F.col("doc_id"), F.col("mark")))
    return rows.where(~F.col(MAY)).drop(MAY), rows.where(MAY).drop(MAY)


def _same(rows: DataFrame, keys: DataFrame) -> Column:
    return (rows["hash"] == keys["key_hash"]) & rows["id"].eqNullSafe(keys["key_id"]) & (rows["mark"] == keys["key_mark"])


def _named(keys: DataFrame, *more: Column) -> DataFrame:
    h = key_hash(F.col("doc_id"), F.col("mark")).alias("key_hash")
    return keys.select(h, F.col("doc_id").alias("key_id"), F.col("mark").alias("key_mark"), *more)


def without(docs: DataFrame, keys: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """Rows of ``docs`` that no row of ``keys`` (doc_id, mark) names; ``mark`` is the
    mark of a row of ``docs``."""
    (sure, open_), named = split(docs, keys, id_col, mark), _named(keys)
    rows = sure.select("row").union(open_.join(named, _same(open_, named), "left_anti").select("row"))
    return rows.select(*unpacked(docs.columns))


def only(docs: DataFrame, keys: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """Rows of ``docs`` that some row of ``keys`` (doc_id, mark) names."""
    open_, named = split(docs, keys, id_col, mark)[1], _named(keys)
    return open_.join(named, _same(open_, named), "left_semi").select(*unpacked(docs.columns))


def with_verdict(docs: DataFrame, verdicts: DataFrame, column: str, kind: str, id_col: str, mark: Column) -> DataFrame:
    """(row, verdict): the rows of ``docs`` with ``column`` of ``verdicts`` (doc_id, mark,
    column; a row for each key at most), null where there is none."""
    (sure, open_), named = split(docs, verdicts, id_col, mark), _named(verdicts, F.col(column).alias("verdict"))
    got = open_.join(named, _same(open_, named), "left").select("row", "verdict")
    return sure.select("row", F.lit(None).cast(kind).alias("verdict")).union(got)

"""Removal of passages that repeat across documents.

Every window of WINDOW words of every document has a Rabin-Karp hash. The windows
are dealt out by hash, each bucket counts its own, and a window that a document
with a smaller id holds too is reported to its document, where reported windows
merge into maximal intervals of words.

A window travels in some 12 bytes: windows of one bucket that a task has read
together are one binary cell (hashes, steps between ids, places). Of windows that
repeat within such a cell's batch only those of the smallest document are dealt
out, the others are reported at once, so however often a passage occurs, a bucket
gets it once a batch.

A window is told by 64 bits and by its bucket, which comes from another hash; among
n windows some n ** 2 / (2 ** 65 * buckets) pairs are taken for equal and are not.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.keys import MAY, flagged
from studyloom.llm.memory import batches_of, trim
from studyloom.llm.storage import materialise

WINDOW = 50
#: Windows that a task gathers before it deals them out.
BATCH = 1 << 21
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Stands for a null id: behind all others.
LAST_ID = 2**63 - 1
#: Odd bases of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class Words(dict):
    """64-bit hashes of words, kept by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


def pieces(data: bytes, most: int = PIECE):
    """``data`` in parts of ``most`` bytes or little more, cut between words."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + most) if at + most < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2 ** 64."""
    inverse = pow(base, -1, 1 << 64)
    ups = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (base, inverse)]
    return ups[0], ups[1]


def rolled(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``size``, by differences of running sums."""
    n = 1 << max(12, (len(words) - 1).bit_length())
    up, down = _powers(base, n)
    sums = np.r_[np.uint64(0), np.cumsum(words * down[: len(words)], dtype=np.uint64)]
    return (sums[size:] - sums[:-size]) * up[: len(words) - size + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def windows(data: bytes, words: Words, size: int = WINDOW):
    """(place of the first, hashes, second hashes) of the windows of a text, piece by piece."""
    carried, at = np.zeros(0, np.uint64), 0
    for piece in pieces(data):
        new = piece.split()
        hashes = np.r_[carried, np.fromiter(map(words.__getitem__, new), np.uint64, len(new))]
        if len(hashes) >= size:
            yield at, _mixed(rolled(hashes, size, BASES[0])), rolled(_mixed(hashes), size, BASES[1])
            at += len(hashes) - size + 1
            hashes = hashes[len(hashes) - size + 1 :]
        carried = hashes


def _least(a: np.ndarray) -> np.ndarray:
    """``a``, unsigned, in the narrowest type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(key: np.ndarray, doc: np.ndarray, at: np.ndarray, ref: np.ndarray) -> bytes:
    """Cell of windows in the order of their documents. ``ref`` takes no place where it
    is the document's id."""
    step, at = _least(np.diff(doc, prepend=doc[:1]).view(np.uint64)), _least(at)
    own = b"" if np.array_equal(ref, doc) else ref.tobytes()
    return b"".join((bytes((key.itemsize, step.itemsize, at.itemsize, 8 * bool(own))), doc[:1].tobytes(), key.tobytes(), step.tobytes(), at.tobytes(), own))


def unpack(cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, at, ref) of a cell."""
    kinds = {0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
    n = (len(cell) - 12) // sum(cell[:4])
    out, x = [], 12
    for width in cell[:4]:
        out.append(np.frombuffer(cell, kinds[width], n if width else 0, x))
        x += n * width
    first = np.frombuffer(cell, np.int64, 1, 4)[0]
    doc = first + np.cumsum(out[1].astype(np.uint64), dtype=np.uint64).view(np.int64)
    return out[0], doc, out[2].astype(np.uint32), out[3].view(np.int64) if cell[3] else doc


def _later(key: np.ndarray, doc: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For rows in an order by key, then document: whether a smaller document has the key."""
    k, d = key[order], doc[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return d > np.repeat(d[start], np.diff(np.r_[start, len(k)]))


def _reports(key: np.ndarray, doc: np.ndarray, at: np.ndarray, ref: np.ndarray, lanes: int, is_open: bool | None = None):
    """Rows (lane, cell) of windows to remove, dealt by document; with ``is_open`` between
    lane and cell if it is given."""
    lane = (_mixed(ref.view(np.uint64)) % np.uint64(lanes)).astype(np.int64) * 2 + (doc == LAST_ID)
    order = np.lexsort((ref, doc, lane))
    lane = lane[order]
    cuts = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]])
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lane)]):
        part = order[x:y]
        cell = pack((key[part] >> np.uint64(32)).astype(np.uint32) if key.itemsize == 8 else key[part], doc[part], at[part].astype(np.uint64), ref[part])
        yield (int(lane[x]) // 2, cell) if is_open is None else (int(lane[x]) // 2, is_open, cell)


def _dealt(parts: list, buckets: int):
    """Rows (bucket, open, cell) of the gathered windows. Open ones are to be counted,
    the others are reports already; these go where their document says."""
    parts.sort(key=lambda p: p[:3])
    key = np.concatenate([p[3] for p in parts])
    lane = np.concatenate([((p[4] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32) for p in parts])
    sizes = [len(p[3]) for p in parts]
    doc, ref = (np.repeat(np.array([p[k] for p in parts], np.int64), sizes) for k in (0, 1))
    at = np.concatenate([np.arange(p[2], p[2] + len(p[3]), dtype=np.int64) for p in parts]).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    later = _later(key, doc, order)
    gone = np.sort(order[later])
    rows = list(_reports(key[gone], doc[gone], at[gone], ref[gone], buckets, False)) if len(gone) else []
    left = np.sort(order[~later])
    left = left[np.argsort(lane[left], kind="stable")]
    own, null = lane[left], doc[left] == LAST_ID
    cuts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (null[1:] != null[:-1])])
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(left)]):
        part = left[x:y]
        rows.append((int(own[x]), True, pack(key[part], doc[part], at[part], ref[part])))
    for x in range(0, len(rows), 500):
        some = rows[x : x + 500]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some]), pa.array([r[2] for r in some], pa.binary())], ["bucket", "open", "cell"])


def _deal(size: int, buckets: int):
    """Deals the windows of rows (doc, ref, text) out."""

    def run(batches):
        words, parts, n = Words(), [], 0
        for batch in batches:
            for doc, ref, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                for at, key, wide in windows(data.as_py() or b"", words, size):
                    parts.append((doc, ref, at, key, wide))
                    n += len(key)
                    if n >= BATCH:
                        yield from _dealt(parts, buckets)
                        parts, n = [], 0
                        trim()
        if parts:
            yield from _dealt(parts, buckets)
        trim()

    return run


def _count(lanes: int):
    """Rows (lane, cell) of the windows that a smaller document holds, dealt by document.
    Rows come bucket by bucket, and one bucket's windows are held at a time."""

    def run(batches):
        held: list = []
        found: list = []
        bucket, n = None, 0

        def settle() -> int:
            if not held:
                return 0
            key, doc, at, ref = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, key))
            gone = order[_later(key, doc, order)]
            held.clear()
            if len(gone):
                found.append(((key[gone] >> np.uint64(32)).astype(np.uint32), doc[gone], at[gone], ref[gone]))
            return len(gone)

        def out():
            rows = list(_reports(*(np.concatenate(x) for x in zip(*found)), lanes))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["lane", "cell"])

        for batch in batches:
            for b, is_open, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != bucket:
                    n += settle()
                    bucket = b
                got = unpack(cell.as_py())
                if is_open:
                    held.append(got)
                else:
                    found.append(got)
                    n += len(got[0])
                if n >= 1_000_000:
                    yield out()
                    n = 0
        settle()
        if found:
            yield out()
        trim()

    return run


def _gather(batches):
    """Rows (unnamed, ref, at, sums), one for each document that has reports; rows come
    lane by lane. ``at`` and ``sums`` are cells of 32-bit places and halves of hashes."""
    held: list = []
    lane = None

    def out():
        sums, doc, at, ref = (np.concatenate(x) for x in zip(*held))
        held.clear()
        unnamed = doc == LAST_ID
        order = np.lexsort((sums, at, ref, unnamed))
        unnamed, ref, at, sums = unnamed[order], ref[order], at[order], sums[order]
        new = np.r_[True, (ref[1:] != ref[:-1]) | (unnamed[1:] != unnamed[:-1])]
        once = new | np.r_[True, (at[1:] != at[:-1]) | (sums[1:] != sums[:-1])]
        unnamed, ref, at, sums, new = (x[once] for x in (unnamed, ref, at, sums, new))
        start = np.flatnonzero(new)
        ends = pa.py_buffer((np.r_[start, len(ref)] * 4).astype(np.int32))
        cells = [pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(x.tobytes())]) for x in (at, sums)]
        return pa.RecordBatch.from_arrays([pa.array(unnamed[start]), pa.array(ref[start]), *cells], ["unnamed", "ref", "at", "sums"])

    for batch in batches:
        for k, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != lane and held:
                yield out()
            lane = k
            held.append(unpack(cell.as_py()))
    if held:
        yield out()
    trim()


def order_id(id_: Column) -> Column:
    """The id by which documents are compared: null comes behind all others."""
    return F.coalesce(id_.cast("long"), F.lit(LAST_ID))


def _named(docs: DataFrame, id_col: str, text: str) -> list[Column]:
    """Columns (doc, unnamed, ref, text) of ``docs``: what reports are addressed by is the
    id, or a hash of the text where that is null."""
    id_, t = F.col(id_col).cast("long"), F.col(text)
    return [order_id(id_).alias("doc"), (order_id(id_) == LAST_ID).alias("unnamed"), F.when(order_id(id_) == LAST_ID, F.xxhash64(t)).otherwise(id_).alias("ref"), t.alias("text")]


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(unnamed, ref, at, sums) for each document that has windows which a smaller id has
    too: cells of places and of parts of the windows' hashes. Written."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * max(1, min(16, 8192 // tasks))
    dealt = docs.select(*_named(docs, id_col, text)).drop("unnamed").mapInArrow(_deal(size, buckets), "bucket int, open boolean, cell binary")
    with batches_of(spark):
        counted = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(2 * tasks), "lane int, cell binary")
        reports = counted.repartition(tasks, "lane").sortWithinPartitions("lane").mapInArrow(_gather, "unnamed boolean, ref long, at binary, sums binary")
        return materialise(reports, "repeats")


def spans_of(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that the windows at the sorted ``starts`` cover."""
    if not len(starts):
        return []
    head = np.flatnonzero(np.r_[True, np.diff(starts) > size])
    return list(zip(starts[head].tolist(), (starts[np.r_[head[1:] - 1, len(starts) - 1]] + size).tolist()))


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType())])


def _cut(size: int):
    """Column function from texts and reports to what stays. A report counts where the
    text's window at its place has its hash: rows may share an id."""

    @F.arrow_udf(_CUT)
    def run(text: pa.Array, places: pa.Array, checks: pa.Array) -> pa.Array:
        counts, spans, kept, words = [], [], [], Words()
        for data, at, sums in zip(text.cast(pa.binary()), places, checks):
            data, at, sums = data.as_py() or b"", at.as_py(), sums.as_py()
            own = data.split()
            cut = []
            if at:
                hashes = [k for _, k, _ in windows(data, words, size)]
                key = (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32) if hashes else np.zeros(0, np.uint32)
                at, sums = np.frombuffer(at, np.uint32), np.frombuffer(sums, np.uint32)
                at, sums = at[at < len(key)], sums[at < len(key)]
                cut = spans_of(np.unique(at[key[at] == sums]).astype(np.int64), size)
            counts.append(len(own))
            spans.append([{"start": a, "end": b} for a, b in cut])
            if cut:
                ends = [0, *[b for _, b in cut]]
                own = [w for a, b in zip(ends, [*[a for a, _ in cut], len(own)]) for w in own[a:b]]
            kept.append(b" ".join(own))
        trim()
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "spans", "kept"])

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(row, n_words, spans, kept) of every row of ``docs``: the row as a struct, the
    number of its words, the intervals of words to remove (end exclusive), and the
    words that stay, joined by one space.

    A word goes if it lies in a window of ``size`` words whose words also stand in a
    row with a smaller id; windows are judged on the input. Null, empty and blank
    texts have no words, and texts of fewer than ``size`` words no window; rows of
    equal id never remove from each other, whether equal or not; a null id is larger
    than any other, and so is 2 ** 63 - 1; an empty table gives an empty table; other columns stay in
    ``row`` whatever their names."""
    rows = docs.select(*_named(docs, id_col, text), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = repeated_windows(docs, id_col, text, size)
    key = F.xxhash64("unnamed", "ref")
    rows = flagged(rows, key, found, key)
    none = F.lit(None).cast("binary")
    sure = rows.where(~F.col(MAY)).select("row", "text", none.alias("at"), none.alias("sums"))
    every = sure.union(rows.where(MAY).join(found, ["unnamed", "ref"], "left").select("row", "text", "at", "sums"))
    return every.select("row", _cut(size)("text", "at", "sums").alias("cut")).select("row", "cut.n_words", "cut.spans", "cut.kept")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with the words that stay as text where something was removed; other
    texts and columns are as they were. Odd rows as in ``cut_repeats``."""
    cut = cut_repeats(docs, id_col, text, size)
    new = F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("row")[text])
    return cut.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])

"""Token ids in byte-aligned variable-length coding, and the files that hold them.

Ids are replaced by their rank of frequency in the corpus (0: most frequent).
A rank takes 1 to 4 bytes; its length less one is a 2-bit code, four codes to a
control byte, lowest bits first. Control bytes and data bytes lie apart, so a
reader expands all lengths by a table of 256 entries and gathers the data with
whole-array operations.

A file set is a folder in Spark's storage: ``ranks`` (id of each rank) and
``shards``, Parquet files of one row per document with doc_id, shard, seq,
offset (ids of the shard before the document), n_tokens, control and data.
Shards are ranges of doc_id, so reading them by (shard, seq) gives the ids in
ascending doc_id order. Spark's committer writes the files; a task that runs
again replaces its own output.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.storage import materialise, new_path

#: Distinct chunks kept by a worker before it starts anew; bounds its memory.
CACHE_CHUNKS = 450_000
CACHE_PARTS = 700_000
_CODES = np.arange(256, dtype=np.uint8)
#: Four lengths for each control byte.
LENGTHS = np.stack([((_CODES >> s) & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of one list of ranks."""
    r = ranks.astype("<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    four = r.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of ``pack``."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.r_[np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)].astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(size > k, raw[at + k] << np.uint32(8 * k), np.uint32(0))
    return out


class _Chunks(dict):
    """Numbers chunks in the order in which they come; ``new`` has those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


#: A word of Latin-1 letters and a tail of ASCII punctuation: the tokenizer
#: splits between them too and lower-cases, and each letter run ends in one token
#: that ends a word, so many words can be encoded as one text and told apart.
_PLAIN = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Words encoded as one text.
JOINED = 50
#: Python takes these for white space, the tokenizer takes them for symbols.
_SYMBOLS = re.compile("[\x1c-\x1f]")
_WITH_SYMBOLS = re.compile(r"(?:\S|[\x1c-\x1f])+")


def chunks_of(text: str | None) -> list[str]:
    """The parts between white space."""
    if not text:
        return []
    return _WITH_SYMBOLS.findall(text) if _SYMBOLS.search(text) else text.split()


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` that begin at ``start``, one after the other."""
    end = np.cumsum(size)
    return flat[np.repeat((start - (end - size)).astype(np.int32), size) + np.arange(int(end[-1]) if len(end) else 0, dtype=np.int32)]


def kind_of(most: int) -> str:
    """Numpy's name of the type that holds ids up to ``most`` between the passes."""
    return "<u2" if most <= 0xFFFF else "<u4"


class _Store:
    """Numbered strings and the ids of each."""

    def __init__(self, kind: str):
        self.index = _Chunks()
        self.flat, self.start, self.size = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
        self.flat, self.size = np.r_[self.flat, flat], np.r_[self.size, size]
        self.index.new = []


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk once.

    Texts are cut at white space, which the tokenizer drops, so the ids of a text
    are those of its chunks. Plain words and their tails are looked up apart."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.kind = kind_of(max(vocab.values()))
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        self.chunks, self.parts = _Store(self.kind), _Store(self.kind)

    def _learn_parts(self) -> None:
        new = self.parts.index.new
        plain = [k for k, w in enumerate(new) if (m := _PLAIN.fullmatch(w)) and not m.group(2)]
        texts = [" ".join([new[k] for k in plain[a : a + JOINED]]) for a in range(0, len(plain), JOINED)]
        other = sorted(set(range(len(new))).difference(plain))
        size = np.zeros(len(new), np.int64)
        got = [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(got) if got else np.zeros(0, self.kind)
        size[plain] = np.diff(np.r_[-1, np.flatnonzero(self.ends_word[flat])])
        more = [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast([new[k] for k in other], add_special_tokens=False)]
        size[other] = [len(x) for x in more]
        order = np.argsort(np.r_[plain, other].astype(np.int64), kind="stable")
        laid = np.r_[size[plain], size[other]].astype(np.int64)
        every = np.concatenate([flat, *more])
        self.parts.add(_gather(every, (np.cumsum(laid) - laid)[order], size), size)

    def _learn(self) -> None:
        part = self.parts.index
        which, count = [], []
        for chunk in self.chunks.index.new:
            m = _PLAIN.fullmatch(chunk)
            if not m:
                which.append(part[chunk])
                count.append(1)
            elif m.group(2):
                which += (part[m.group(1).lower()], part[m.group(2)])
                count.append(2)
            else:
                which.append(part[chunk.lower()])
                count.append(1)
        if part.new:
            self._learn_parts()
        at = np.array(which, np.int64)
        n = self.parts.size[at]
        first = np.cumsum(count) - count
        self.chunks.add(_gather(self.parts.flat, self.parts.start[at], n), np.add.reduceat(n, first) if len(n) else n)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if len(self.chunks.index) > CACHE_CHUNKS:
            self.chunks = _Store(self.kind)
        if len(self.parts.index) > CACHE_PARTS:
            self.parts = _Store(self.kind)
        index, which = self.chunks.index, []
        for t in texts:
            chunks = chunks_of(t)
            which.append(np.fromiter(map(index.__getitem__, chunks), np.int32, len(chunks)))
        if index.new:
            self._learn()
        at = np.concatenate(which) if which else np.zeros(0, np.int32)
        n = self.chunks.size[at]
        ids = _gather(self.chunks.flat, self.chunks.start[at], n)
        ends = np.cumsum([len(w) for w in which])
        return ids, np.diff(np.r_[0, np.cumsum(n)][np.r_[0, ends].astype(np.int64)])


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def id_kind(tokenizer_file: str, end_id: int) -> str:
    """``kind_of`` the largest id that the file or the end mark can give."""
    return kind_of(max(end_id, len(_encoder(tokenizer_file).ends_word) - 1))


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and raw ids (little-endian, of ``id_kind``) of every row."""
    kind = id_kind(tokenizer_file, end_id)
    width = np.dtype(kind).itemsize

    def run(batches):
        enc = _encoder(tokenizer_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 2000):
                part = texts[a : a + 2000]
                ids, n = enc.encode(part)
                ids = np.insert(ids.astype(kind), np.cumsum(n), end_id)
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, width * np.cumsum(n + 1)].astype("<i4")), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array(n + 1, pa.int64()), raw], ["doc_id", "n_tokens", "raw"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, raw binary")


def _in_order(rows: DataFrame, n_shards: int, ids: DataFrame) -> DataFrame:
    """Rows in shards of consecutive doc_id, numbered and summed up within a shard;
    ``ids`` has the same doc_ids at less cost.

    Repeated doc_ids stay repeated, ordered by their ids; null comes first."""
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n_shards) for k in range(1, n_shards)]), 10_000).alias("c")).first()["c"] if n_shards > 1 else []
    shard = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))])
        shard = F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(0))
    placed = rows.withColumn("shard", shard).repartition(n_shards, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "raw")
    schema = T.StructType([*placed.schema.fields, T.StructField("seq", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        last, seq, total = None, 0, 0
        for batch in batches:
            shards = batch.column("shard").to_pylist()
            counts = batch.column("n_tokens").to_pylist()
            seqs, offsets = [], []
            for s, n in zip(shards, counts):
                if s != last:
                    last, seq, total = s, 0, 0
                seqs.append(seq)
                offsets.append(total)
                seq += 1
                total += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())], [f.name for f in schema.fields])

    return placed.mapInArrow(run, schema)


def id_counts(rows: DataFrame, kind: str = "<u2") -> DataFrame:
    """(id, n) over all rows; at most one row for each id of the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return rows.select("raw").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_id_files(docs: DataFrame, tokenizer_file: str, path: str | None = None, end_id: int = 2, n_shards: int | None = None, id_col: str = "doc_id", text: str = "text") -> str:
    """Encode every whole text, append ``end_id``, and write the file set; returns its path.

    Null text counts as empty and has the end id only. An empty table gives a
    file set without rows. Columns of ``docs`` other than id and text are not
    written. The rank table has one entry for each id of the vocabulary that
    occurs (a fixed bound), so it goes to the driver and to every task."""
    spark = docs.sparkSession
    path = path or new_path(spark, "ids")
    n_shards = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(tokenise(docs, tokenizer_file, end_id, id_col, text), "id-rows")
    kind = id_kind(tokenizer_file, end_id)
    counts = id_counts(rows, kind).collect()
    order = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = spark.sparkContext.broadcast(rank)

    def code(batches):
        for batch in batches:
            got = [pack(ranks.value[np.frombuffer(raw.as_buffer(), kind)]) for raw in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())], ["doc_id", "n_tokens", "control", "raw"])

    coded = rows.mapInArrow(code, "doc_id long, n_tokens long, control binary, raw binary")
    _in_order(coded, n_shards, rows).withColumnRenamed("raw", "data").write.option("compression", "zstd").parquet(f"{path}/shards")
    return path


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, seq, start, n_tokens and ids (binary, little-endian unsigned
    32-bit) of each document; ``start`` counts the ids of all documents before it."""
    order = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    ids = spark.sparkContext.broadcast(np.array([r["id"] for r in order], "<u4"))
    shards = spark.read.parquet(f"{path}/shards")
    sums = sorted((r["shard"], r["n"]) for r in shards.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = [], 0
    for shard, n in sums:
        before.append((shard, total))
        total += n
    base = spark.createDataFrame(before, "shard int, before long")

    def expand(batches):
        for batch in batches:
            n = batch.column("n_tokens").to_pylist()
            got = [ids.value[unpack(c.as_py(), d.as_py(), k)].tobytes() for c, d, k in zip(batch.column("control"), batch.column("data"), n)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "shard", "seq", "start", "n_tokens")] + [pa.array(got, pa.binary())], ["doc_id", "shard", "seq", "start", "n_tokens", "ids"])

    placed = shards.join(F.broadcast(base), "shard").withColumn("start", F.col("before") + F.col("offset"))
    return placed.select("doc_id", "shard", "seq", "start", "n_tokens", "control", "data").mapInArrow(expand, "doc_id long, shard int, seq long, start long, n_tokens long, ids binary")

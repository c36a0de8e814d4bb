"""Near-duplicates by SimHash fingerprints and anchor points of a covering code.

Two fingerprints that differ in THRESHOLD bits or fewer differ in at most
THRESHOLD // blocks bits of one of the blocks their 64 bits are cut into. In
each block the anchors are the words of a covering code: a Hamming code (every
word lies within 1 of a code word) beside free bits. A fingerprint's home is its
nearest anchor; it is copied to every anchor within covering radius plus block
threshold. A pair within the block threshold then meets at the home of either
one, where homes are compared with copies on all 64 bits. Three blocks of 21 or
22 bits (42 copies, 2 ** 17 anchors each) serve up to MANY fingerprints; beyond,
two blocks of 32 bits (some 400 copies, 2 ** 27 anchors each) make 100 times
fewer comparisons. Equal fingerprints are one node; a dense anchor's rows are cut
into chunks that meet pairwise, and a chunk pair returns a spanning forest of its
links, so neither a task nor its result grows with the square of a group.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.components import components
from studyloom.llm.keys import NO_ID, mark_of, only, without
from studyloom.llm.memory import trim
from studyloom.llm.storage import materialise, packed, unpacked

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: Least and most bits (exclusive) of the blocks, and the length of their Hamming
#: code, for fewer and for more fingerprints than MANY.
PLANS = ((((0, 21), (21, 42), (42, 64)), 15), (((0, 32), (32, 64)), 31))
MANY = 30_000_000
#: Rows of one anchor that are compared at once.
CHUNK = 2048
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles in order, repeats included; texts of fewer words, but
    not none, are one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-size]]
    return np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint; bit k is 1 if it is set in over half the shingle hashes.
    Null and texts without words give 0."""
    return majority(shingle_hashes(text))


def fingerprints(text: Column) -> Column:
    """Fingerprints as signed 64-bit numbers."""

    @F.arrow_udf(T.LongType())
    def run(column: pa.Array) -> pa.Array:
        made = np.array([fingerprint(x.as_py()) for x in column], np.uint64).view(np.int64)
        trim()
        return pa.array(made)

    return run(text)


class Covering:
    """Code words of a block and the way to the ones near a word.

    The first ``coded`` bits are coded, the rest of the block is free. Position i of
    the coded part has the check column i + 1, so the syndrome of a word is the
    exclusive or of the columns of its ones, and names the bit to flip."""

    def __init__(self, width: int, threshold: int, coded: int):
        self.coded = coded
        self.checks = [sum(1 << i for i in range(coded) if (i + 1) >> j & 1) for j in range(coded.bit_length())]
        reach = 1 + threshold
        # errors of up to ``reach`` bits that lead to a code word, for each syndrome;
        # free bits may be among them
        moves: dict[int, list[int]] = {}
        for n in range(reach + 1):
            for places in combinations(range(width), n):
                syndrome = 0
                for i in places:
                    syndrome ^= i + 1 if i < coded else 0
                moves.setdefault(syndrome, []).append(sum(1 << i for i in places))
        self.moves = {s: np.array(m, np.int64) for s, m in moves.items()}

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(words & m).astype(np.int64) & 1) << j for j, m in enumerate(self.checks))

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and anchors of all copies of the words of a block."""
        s = self.syndromes(words)
        at, out = [], []
        for k, moves in self.moves.items():
            rows = np.flatnonzero(s == k)
            if len(rows):
                at.append(np.repeat(rows, len(moves)))
                out.append((words[rows][:, None] ^ moves[None, :]).ravel())
        return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, np.int64),) * 2

    def homes(self, words: np.ndarray) -> np.ndarray:
        s = self.syndromes(words)
        return words ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)


def copies(prints: DataFrame, plan: int = 0) -> DataFrame:
    """(anchor, home, fp): every fingerprint at every anchor in reach, in each block."""
    blocks, coded = PLANS[plan]

    def run(batches):
        codes = [Covering(b - a, THRESHOLD // len(blocks), coded) for a, b in blocks]
        for batch in batches:
            for z in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(z, 2000).to_numpy(zero_copy_only=False)
                for k, ((a, b), code) in enumerate(zip(blocks, codes)):
                    word = (fp.view(np.uint64) >> np.uint64(a)).astype(np.int64) & ((1 << (b - a)) - 1)
                    at, anchor = code.anchors(word)
                    home = code.homes(word)[at] == anchor
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | (k << 40)), pa.array(home), pa.array(fp[at])], ["anchor", "home", "fp"])

    return prints.select("fp").mapInArrow(run, "anchor long, home boolean, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links, at most one less than there are nodes, that join the same nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(k)
    return a[keep], b[keep]


def _compare(key: np.ndarray, home: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and copies of the same key; rows are sorted by key."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    group = np.repeat(np.arange(len(start)), size)
    rows = np.flatnonzero(home & (size[group] > 1))
    count = size[group[rows]]
    out_a, out_b = [], []
    # some million pairs at once
    ends = np.cumsum(count)
    x = 0
    while x < len(rows):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + 2_000_000, "right")))
        n = count[x:y]
        first = np.cumsum(n) - n
        left = np.repeat(rows[x:y], n)
        right = np.repeat(start[group[rows[x:y]]] - first, n) + np.arange(int(n.sum()))
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= THRESHOLD) & (fp[left] != fp[right])
        a, b = fp[left[near]], fp[right[near]]
        if len(a) > 4 * (y - x):
            a, b = forest(a, b)
        out_a.append(a)
        out_b.append(b)
        x = y
    a, b = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (out_a, out_b))
    return forest(a, b) if len(a) else (a, b)


def links(prints: DataFrame, plan: int | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints: links that join what all links within
    THRESHOLD join. The plan goes by their number unless it is given."""
    spark = prints.sparkSession
    if plan is None:
        plan = int(prints.count() > MANY)
    placed = copies(prints, plan)
    dense = placed.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("anchor", F.ceil(F.col("n") / CHUNK).cast("int").alias("cuts"))
    dense = materialise(dense, "dense")
    sliced = placed.join(dense, "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    # a home meets every chunk of copies, a copy every chunk of homes
    sent = sliced.select("anchor", "home", "fp", "cuts", own.alias("own"))
    single = sent.where("cuts = 1").select(F.col("anchor").alias("key"), F.lit(0).alias("cell"), "home", "fp")
    many = sent.where("cuts > 1")
    homes = many.where("home").select("anchor", "fp", F.lit(True).alias("home"), (F.col("own") * F.col("cuts")).alias("row"), F.explode(every).alias("other"))
    homes = homes.select(F.col("anchor").alias("key"), (F.col("row") + F.col("other")).alias("cell"), "home", "fp")
    others = many.select("anchor", "fp", F.lit(False).alias("home"), "own", "cuts", F.explode(every).alias("other"))
    others = others.select(F.col("anchor").alias("key"), (F.col("other") * F.col("cuts") + F.col("own")).alias("cell"), "home", "fp")
    rows = single.union(homes).union(others)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key", "cell").sortWithinPartitions("key", "cell")

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)]

        def out(part):
            # key and cell as one number that changes where either does
            change = np.r_[False, (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1])] if len(part[0]) else np.zeros(0, bool)
            a, b = _compare(np.cumsum(change), part[2], part[3])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            new = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(held[0]) < 50_000 or not len(last):
                continue
            cut = int(last[-1]) + 1
            yield out([x[:cut] for x in held])
            held = [x[cut:] for x in held]
        if len(held[0]):
            yield out(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, fp, component_id, root) of every row; component_id is the least
    doc_id that links of THRESHOLD bits or fewer reach, root the least fingerprint,
    mark a hash of the text.

    Null and wordless texts have fingerprint 0 and link like any other. Repeated
    rows stay repeated and link to each other. A null doc_id is never a
    component_id unless its component has no other. An empty table gives an
    empty table."""
    t = F.col(text)
    prints = materialise(docs.select(F.col(id_col).alias("doc_id"), mark_of(t).alias("mark"), fingerprints(t).alias("fp")), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    label = components(links(nodes)).select(F.col("node").alias("fp"), "root")
    # written, so that the join with all rows, which may be skewed, stands alone
    classes = materialise(classified(nodes, label, "fp"), "classes")
    return prints.join(classes, "fp").select("doc_id", "mark", "fp", "component_id", "root")


def classified(nodes: DataFrame, label: DataFrame, node: str) -> DataFrame:
    """(node, root, component_id) of all ``nodes`` (node, least) from the labels (node,
    root) of those that have links."""
    rooted = nodes.join(label, node, "left").select(node, "least", F.coalesce("root", node).alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select(node, "root", "component_id")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component in ``classes`` (doc_id, mark, root) one row of ``docs``: the
    one with the least id, of several the one with the least mark; a null id comes
    last. Of rows that are equal in id and text any one stays.

    Texts are dealt out only of rows that go or that may be repeated."""
    rows = materialise(classes.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n")), "rows")
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(NO_ID)), "mark")
    best = rows.groupBy("root").agg(F.min_by("doc_id", order).alias("_id"), F.min_by("mark", order).alias("_mark"))
    judged = rows.join(best, "root").withColumn("wins", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    judged = materialise(judged.select("doc_id", "mark", "n", "wins"), "rows")
    mark = mark_of(F.col(text))
    kept = without(docs, judged.where("not wins").select("doc_id", "mark"), id_col, mark)
    again = judged.where("wins and n > 1").select("doc_id", "mark")
    if not again.take(1):
        return kept
    single = packed(only(docs, again, id_col, mark), F.col(id_col).alias("id"), mark.alias("mark")).dropDuplicates(["id", "mark"])
    return without(kept, again, id_col, mark).union(single.select(*unpacked(docs.columns)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, see ``keep_one``; documents
    with a null id are different rows and stay if nothing is linked to them. An
    empty table gives an empty table; other columns are kept as they are."""
    return keep_one(docs, near_duplicates(docs, id_col, text), id_col, text)

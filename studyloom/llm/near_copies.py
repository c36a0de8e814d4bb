"""Near copies by word shingles: SimHash finds the close pairs, MinHash buckets the
rest, whole sets of SHINGLE-word shingles confirm Jaccard similarity 0.8 or more.

At similarity 0.8 two 64-bit fingerprints differ in 10 bits on average, 3 more or
less; an anchor search that wide would compare a fixed share of all pairs. So the
anchors (``simhash.links``, THRESHOLD bits) join what is close, and BANDS x ROWS
least hash values bring together what is not: a pair at similarity s shares none
of the BANDS buckets with probability (1 - s**ROWS)**BANDS, 1.5e-5 at 0.8. Pairs
whose fingerprints differ in more than FAR bits, 6 deviations beyond 0.8, are not
confirmed.

Rows with equal shingle sets are one node. A bucket doesn't give all its pairs:
every node meets a few pivots of each of its buckets first, so a group of copies
is joined by work that grows with its rows, not with their square. In the first round the
pivot is the node with the most links so far (the text that others are copies
of). Buckets that still hold several components go through a second round with
PIVOTS pivots. In what then still holds several components, all pairs of nodes of
different components meet that have not met, in blocks of CHUNK nodes a side, so
no bucket leaves out a pair that could join two components. Blocks compare parities
first: of each set PARITY bits, each the parity of the shingles that fall on it. Two
parities differ in no more bits than their sets have shingles apart, so a pair that
differs in more than the threshold allows is none, for certain; only the others meet
as whole sets. What can grow with the square of a bucket, one whose nodes are all
alike but below the threshold, is that comparison of bits; it is dealt out by blocks,
and no task holds more than one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm import simhash
from studyloom.llm.components import components
from studyloom.llm.keys import mark_of, only
from studyloom.llm.memory import trim
from studyloom.llm.simhash import SEED, classified, keep_one, majority, shingle_hashes
from studyloom.llm.storage import materialise

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 28, 5
#: Pivots of a bucket in the second round.
PIVOTS = 2
#: Nodes of a side of a block when the rest of a bucket is compared.
CHUNK = 1000
FAR = 27
#: Bits of a parity, a multiple of 64.
PARITY = 512
_RNG = np.random.default_rng(SEED)
_FLIP, _ODD = (_RNG.integers(0, 2**64 - 1, BANDS * ROWS, np.uint64, endpoint=True) for _ in range(2))
_ODD |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, SHINGLE))


def node_of(found: np.ndarray) -> int:
    """The number of a set; 0 if it is empty."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def buckets_of(found: np.ndarray) -> np.ndarray:
    """One bucket for each band; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for x in range(0, len(found), 128):
        part = found[x : x + 128, None] ^ _FLIP
        part *= _ODD
        np.minimum(low, part.min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def parity_of(found: np.ndarray) -> np.ndarray:
    """PARITY bits, each whether an odd number of hashes fall on it."""
    odd = np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _lists(made: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(flat))


def _each(batches, columns):
    """``columns`` of some hundred rows at a time, so that lists stay small."""
    for batch in batches:
        for x in range(0, batch.num_rows, 250):
            part = batch.slice(x, 250)
            yield columns(part, [shingles(t) for t in part.column(part.num_columns - 1).to_pylist()])
        trim()


def _long(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, n, fp, buckets) of every row of (doc_id, mark, text); n
    counts shingles, fp is the fingerprint of the set."""

    def columns(part, sets):
        n = pa.array([len(s) for s in sets], pa.int32())
        made = [_long([node_of(s) for s in sets]), n, _long([majority(s) for s in sets]), _lists([buckets_of(s) for s in sets])]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["doc_id", "mark", "node", "n", "fp", "buckets"])

    return docs.mapInArrow(lambda batches: _each(batches, columns), "doc_id long, mark long, node long, n int, fp long, buckets array<long>")


def whole_sets(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, set) of ``nodes`` (node, doc_id, mark), made again from one text of each."""

    def columns(part, sets):
        return pa.RecordBatch.from_arrays([_long([node_of(s) for s in sets]), _lists(sets)], ["node", "set"])

    rows = only(docs, nodes.select("doc_id", "mark"), "doc_id", mark_of(F.col(text)))
    return rows.select(text).mapInArrow(lambda batches: _each(batches, columns), "node long, set array<long>").dropDuplicates(["node"])


def parities(sets: DataFrame) -> DataFrame:
    """(node, odd) of ``sets`` (node, set)."""

    def run(batches):
        for batch in batches:
            found = [s.values.to_numpy().view(np.uint64) for s in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists([parity_of(s) for s in found])], ["node", "odd"])

    return sets.mapInArrow(run, "node long, odd array<long>")


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _likely(n: Column, m: Column, fp: Column, other: Column) -> Column:
    """Sizes allow the similarity, and fingerprints don't speak against it."""
    p, q = LEAST
    return (F.least(n, m) * q >= F.greatest(n, m) * p) & (F.bit_count(fp.bitwiseXOR(other)) <= FAR)


def _apart(n: Column, m: Column, odd: Column, other: Column) -> Column:
    """Parities differ in more bits than sets of the threshold can."""
    p, q = LEAST
    bits = sum((F.bit_count(odd[k].bitwiseXOR(other[k])) for k in range(PARITY // 64)), F.lit(0))
    return bits * (p + q) > (n + m) * (q - p)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach LEAST."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    p, q = LEAST
    return both.where(common * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b")


def links(nodes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b) of ``nodes`` (node, n, fp, buckets, doc_id, mark): confirmed pairs that
    join what all confirmed candidates join."""
    prints = materialise(nodes.where("n > 0").groupBy("fp").agg(F.min_by(F.struct("node", "n", "fp"), "node").alias("head")), "prints")
    close = materialise(simhash.links(prints), "close")
    placed = nodes.select("node", "n", "fp", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(placed.join(shared, "bucket"), "members")
    # nodes of one fingerprint, and fingerprints that the anchors link
    equal = nodes.join(prints, "fp").where(F.col("node") != F.col("head.node")).select(*_ordered(F.col("node"), F.col("head.node")))
    head = lambda c: prints.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    linked = close.join(head("a"), "a").join(head("b"), "b").where(_likely(F.col("a_head.n"), F.col("b_head.n"), F.col("a"), F.col("b")))
    seeds = materialise(equal.union(linked.select(*_ordered(F.col("a_head.node"), F.col("b_head.node")))).distinct(), "seeds")
    asked = members.select("node").union(seeds.select("a")).union(seeds.select("b")).distinct()
    sets = materialise(whole_sets(nodes.join(asked, "node", "left_semi"), docs, text), "sets")
    found = materialise(confirmed(seeds, sets), "links")
    degree = found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    rows = members.join(degree, "node", "left").select("bucket", "node", "n", "fp", F.col("node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    first = materialise(_met(rows, 1).join(seeds, ["a", "b"], "left_anti"), "pairs")
    found = materialise(found.union(confirmed(first, sets)), "links")
    rows = _labelled(members, found)
    second = materialise(_met(_mixed(rows), PIVOTS).join(seeds.union(first), ["a", "b"], "left_anti"), "pairs")
    found = materialise(found.union(confirmed(second, sets)), "links")
    rest = _mixed(_labelled(members, found))
    if not rest.take(1):
        return found
    third = _blocks(rest.join(parities(sets.join(rest.select("node").distinct(), "node", "left_semi")), "node")).join(seeds.union(first).union(second), ["a", "b"], "left_anti")
    return materialise(found.union(confirmed(materialise(third, "pairs"), sets)), "links")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the buckets with the root of each node by the links ``found``."""
    rows = members.join(components(found), "node", "left").select("bucket", "node", "n", "fp", F.coalesce("root", "node").alias("root"), F.lit(0).alias("degree"))
    return materialise(rows, "labelled")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("bucket")
    return rows.join(mixed, "bucket", "left_semi")


def _blocks(rows: DataFrame) -> DataFrame:
    """(a, b): all likely pairs of nodes of a bucket with different roots whose parities
    allow the similarity. A bucket's nodes are dealt into parts by hash, some CHUNK a
    part; a block is a pair of parts."""
    parts = rows.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    dealt = rows.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = dealt.withColumn("q", every).where("part <= q").select("bucket", F.col("part").alias("p"), "q", "node", "n", "fp", "root", "odd")
    two = dealt.withColumn("p", every).where("p <= part").select("bucket", "p", F.col("part").alias("q"), *[F.col(c).alias(f"{c}_") for c in ("node", "n", "fp", "root", "odd")])
    near = one.join(two, ["bucket", "p", "q"]).where((F.col("root") != F.col("root_")) & ((F.col("p") < F.col("q")) | (F.col("node") < F.col("node_"))))
    near = near.where(_likely(F.col("n"), F.col("n_"), F.col("fp"), F.col("fp_")) & ~_apart(F.col("n"), F.col("n_"), F.col("odd"), F.col("odd_")))
    return near.select(*_ordered(F.col("node"), F.col("node_"))).distinct()


def _met(rows: DataFrame, pivots: int) -> DataFrame:
    """(a, b): every node of ``rows`` (bucket, node, n, fp, root, degree) with the
    pivots of its buckets that have another root: those of the highest degree, of
    equal ones such as a hash of node and bucket picks."""
    pivot = F.struct("degree", F.xxhash64("node", "bucket").alias("h"), "node", "n", "fp", "root")
    chosen = rows.select("bucket", pivot.alias("p")).groupBy("bucket").agg(F.max("p").alias("p")) if pivots == 1 else _top(rows.select("bucket", pivot.alias("p")), pivots)
    near = rows.join(chosen, "bucket").where((F.col("root") != F.col("p.root")) & _likely(F.col("n"), F.col("p.n"), F.col("fp"), F.col("p.fp")))
    return near.select(*_ordered(F.col("node"), F.col("p.node"))).distinct()


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` greatest p of each bucket. The rank filter also runs before the shuffle."""
    order = Window.partitionBy("bucket").orderBy(F.desc("p"))
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, node, component_id, root) of every row; component_id is the least
    doc_id that links of similarity LEAST or more reach, root the least node.

    Null and wordless texts are one node. Repeated rows stay repeated. A null
    doc_id is never a component_id unless its component has no other. An empty
    table gives an empty table."""
    rows = docs.select(F.col(id_col).alias("doc_id"), mark_of(F.col(text)).alias("mark"), F.col(text).alias("text"))
    made = materialise(sketches(rows), "sketches")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))
    nodes = made.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets"), one.alias("one"))
    nodes = materialise(nodes.select("node", "least", "n", "fp", "buckets", "one.doc_id", "one.mark"), "nodes")
    label = components(links(nodes, rows.drop("mark"))).select("node", "root")
    classes = materialise(classified(nodes.select("node", "least"), label, "node"), "classes")
    return made.select("doc_id", "mark", "node").join(classes, "node").select("doc_id", "mark", "node", "component_id", "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies, see ``simhash.keep_one``."""
    return keep_one(docs, near_copies(docs, id_col, text), id_col, text)

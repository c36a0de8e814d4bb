"""Connected components by alternating star contraction (large star, small star).

A star step deals the links out by node, sorted, and streams through them: the
first row of a node has its least neighbour, so no group is held in memory, and
repeated links lie side by side. Links carry a mark whether the step that made
them still saw anything but stars; when none does, every node points at its root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.storage import materialise

_SCHEMA = "a long, b long, open boolean"


def _star(large: bool):
    """A step over rows (a, b, open) sorted by a, then b. Large: links from larger
    neighbours to the least one, ``a`` included; small: links from ``a`` and its
    smaller neighbours to the least one."""

    def run(batches):
        last_a = last_b = last_m = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, was = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "open"))
            first = np.r_[a[0] != last_a if last_a is not None else True, a[1:] != a[:-1]]
            again = ~first & (b == np.r_[b[0] if last_b is None else last_b, b[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(a)), -1))
            m = np.where(head >= 0, np.minimum(a, b)[head], a[0] if last_m is None else last_m)
            if large:
                keep = ~again & (b > a)
                out = (b[keep], m[keep], (m < a)[keep])
            else:
                other = ~again & (b != m)
                out = (np.r_[a[first], b[other]], np.r_[m[first], m[other]], np.r_[was[first], np.ones(int(other.sum()), bool)])
            last_a, last_b, last_m = a[-1], b[-1], m[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b", "open"])

    return run


def _step(links: DataFrame, large: bool) -> DataFrame:
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links.repartition(tasks, "a").sortWithinPartitions("a", "b", F.desc("open")).mapInArrow(_star(large), _SCHEMA)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); root is the least node
    that can be reached. Nodes without an edge are not returned; loops and repeated
    edges change nothing; an empty table gives an empty table.

    Each round deals the links out twice and writes them to the shared folder. The
    number of rounds grows with the logarithm of the longest path."""
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(False).alias("open"))
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "open"))
        links = materialise(_step(_step(both, True), False), "stars")
        if not links.where("open").take(1):
            every = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return every.union(every.select("root", "root")).distinct()
    raise RuntimeError("components did not settle")

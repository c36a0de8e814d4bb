"""pairs of a large bucket that no pivot is part of."""

import random

import numpy as np
from pyspark.sql import functions as F

from studyloom.llm import near_copies
from studyloom.llm.keys import mark_of


def test_every_pair_of_a_bucket(spark, monkeypatch):
    """Ten pairs of copies in one bucket of texts that are alike but below 0.8."""
    monkeypatch.setattr(near_copies, "CHUNK", 7)  # several blocks
    rng = random.Random(5)
    base, texts = [f"w{rng.randint(0, 5000)}" for _ in range(300)], []
    for k in range(10):
        own = base[:255] + [f"p{k}x{x}" for x in range(45)]
        texts += [" ".join(own), " ".join([*own[:-8], *(f"q{k}x{x}" for x in range(8))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", mark_of(F.col("text")).alias("mark"), "text")
    nodes = near_copies.sketches(rows).withColumn("buckets", F.array(F.lit(1).cast("long"))).localCheckpoint()
    of = {r["node"]: r["doc_id"] for r in nodes.collect()}
    found = {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in near_copies.links(nodes, rows.drop("mark")).collect()}
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    want = {(a, b) for b in range(20) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want == {(2 * k, 2 * k + 1) for k in range(10)} and found == want


def test_parities_differ_less_than_sets():
    """Pipeline: the filter of blocks never exceeds what sets have apart."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 700, 5000):
        one = np.unique(rng.integers(0, 2**63, n, np.uint64))
        for m in (0, 3, 60, 2000):
            other = np.unique(np.concatenate([one[: max(0, n - m)], rng.integers(0, 2**63, m, np.uint64)]))
            bits = sum(int(x).bit_count() for x in near_copies.parity_of(one) ^ near_copies.parity_of(other))
            assert bits <= len(np.setxor1d(one, other))


def test_a_bucket_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    """Pipeline: texts that are all alike but below 0.8 don't meet as whole sets, and
    the few that are copies still do."""
    rng = random.Random(7)
    base, texts = [f"w{rng.randint(0, 5000)}" for _ in range(150)], []
    for k in range(60):
        own = [w if rng.random() > 0.05 else f"p{k}x{x}" for x, w in enumerate(base)]
        texts.append(" ".join(own))
        if k % 20 == 0:
            texts.append(" ".join([*own[:-5], *(f"q{k}x{x}" for x in range(5))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", mark_of(F.col("text")).alias("mark"), "text")
    nodes = near_copies.sketches(rows).withColumn("buckets", F.array(F.lit(1).cast("long"))).localCheckpoint()
    of = {r["node"]: r["doc_id"] for r in nodes.collect()}
    met, confirmed = [], near_copies.confirmed
    monkeypatch.setattr(near_copies, "confirmed", lambda pairs, sets: met.append(pairs.count()) or confirmed(pairs, sets))
    found = {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in near_copies.links(nodes, rows.drop("mark")).collect()}
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in want} >= found and len(want) >= 3
    assert _classes(len(sets), found) == _classes(len(sets), want)
    assert len(met) == 4 and met[3] < 0.1 * len(sets) * (len(sets) - 1) / 2


def _classes(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        low, high = sorted((of[a], of[b]))
        of = [low if x == high else x for x in of]
    return of

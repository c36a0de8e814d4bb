"""Ranked lexical search, impact-ordered and score-at-a-time.

The documents stay where they are: a first pass writes each document's terms and
their numbers, sums over these give the statistics of the corpus, and a second pass
gathers documents into shards. A shard orders the postings of each term by impact;
postings of equal impact lie together. For a query it takes the postings of all
terms in descending impact, a level at a time, and adds them up. It stops as soon
as the best postings left of all terms together can't lift a document that has not
been seen to the k-th best sum so far; the scores of documents that may still be
among the k best are then completed from their own terms. So a shard's k best are
exact, and the k best of all shards' are those of the corpus. Only these are
shuffled.

Queries are taken in blocks of BLOCK pairs of query and term, which is what a task
holds of them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.memory import batches_of, trim
from studyloom.llm.storage import materialise

TOP = 50
#: Documents and postings of a shard, at most (a document is never divided).
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
#: Pairs of query and term that are searched at once, and query terms that an index
#: may be restricted to.
BLOCK, VOCABULARY = 100_000, 1_000_000
#: A level of impacts ends where they have fallen to this share of the last level's.
FALL = 0.6
#: Separators become spaces, A-Z lower case, all other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def term_id(term: bytes) -> int:
    """64-bit number of a term, signed."""
    x = xxhash.xxh64_intdigest(term)
    return x - (1 << 64) if x >> 63 else x


class _Ids(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[term] = made = term_id(term)
        return made


def query_terms(queries: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, place, term): the distinct terms of each row of ``queries``; ``place``
    numbers the rows, so that rows of one id stay apart."""

    def run(batches):
        for batch in batches:
            ids, places, terms = [], [], []
            for id_, place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                own = sorted({term_id(t) for t in terms_of(data.as_py() or b"")})
                ids += [id_] * len(own)
                places += [place] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(terms, pa.int64())], ["item_id", "place", "term"])

    rows = queries.select(F.col(id_col).cast("long").alias("item_id"), F.monotonically_increasing_id().alias("place"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item_id long, place long, term long")


def index_terms(docs: DataFrame, only: set[int] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of every row of ``docs``, written: the number of its
    terms with repeats, and its distinct terms, of ``only`` if that is given, with the
    number of each. Null and termless texts have none."""
    spark = docs.sparkSession
    sent = None if only is None else spark.sparkContext.broadcast(np.array(sorted(only), np.int64))

    def run(batches):
        wanted = None if sent is None else set(sent.value.tolist())
        ids = _Ids()
        for batch in batches:
            docs_, sizes, terms, counts = batch.column(0), [], [], []
            for data in batch.column(1).cast(pa.binary()):
                own = terms_of(data.as_py() or b"")
                found = Counter(own)
                pairs = [(i, c) for t, c in found.items() for i in (ids[t],) if wanted is None or i in wanted]
                sizes.append(len(own))
                terms.append([p[0] for p in pairs])
                counts.append([p[1] for p in pairs])
            yield pa.RecordBatch.from_arrays([docs_, pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])
            trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with batches_of(spark):
        return materialise(rows.mapInArrow(run, "doc_id long, n long, terms array<long>, counts array<long>"), "terms")


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Number of documents with a term, and of all their terms."""
    row = index.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    return row["n"], row["l"]


def term_weights(index: DataFrame, n_docs: int) -> DataFrame:
    """(term, w) of every indexed term."""
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(n_docs).cast("double") + 2) / (2 * F.col("df").cast("double") + 1)))
    return df.select("term", w.cast("long").alias("w"))


class Shard:
    """Postings of some documents, by term and descending impact, and by document."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray, total: tuple[int, int]):
        """``lengths``: numbers of postings of the documents, whose terms (places in the
        vocabulary) and counts follow each other in ``term`` and ``tf``."""
        n_docs, n_terms = total
        self.docs, self.first = docs, np.r_[0, np.cumsum(lengths)]
        m = 50 + (50 * sizes * n_docs) // max(1, n_terms)
        owner = np.repeat(np.arange(len(docs)), lengths)
        self.by_doc = term, (1_000_000_000 * tf) // (1000 * tf + 20 * m[owner])
        order = np.lexsort((owner, -self.by_doc[1], term))
        self.owner, self.impact = owner[order], self.by_doc[1][order]
        self.terms, start = np.unique(term[order], return_index=True)
        self.start = np.r_[start, len(order)]

    def _slices(self, terms: np.ndarray, w: np.ndarray):
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (w > 0)
        here[here] = self.terms[at[here]] == terms[here]
        return [(int(self.start[k]), int(self.start[k + 1]), int(x)) for k, x in zip(at[here], w[here])]

    def top(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents with a score above 0; equal
        scores by ascending id."""
        lists = self._slices(terms, w)
        sums, seen = np.zeros(len(self.docs), np.int64), np.zeros(0, np.int64)
        left = [[a, b, x] for a, b, x in lists]
        level = max((self.impact[a] * x for a, _, x in lists), default=0)
        bar = rest = 0
        while left:
            level = int(level * FALL)
            for part in left:
                a, b, x = part
                # impacts fall: those of the level or above come first
                end = a + int(np.searchsorted(-self.impact[a:b], -(-(-level // x)), "right"))
                sums[self.owner[a:end]] += self.impact[a:end] * x
                part[0] = end
            left = [p for p in left if p[0] < p[1]]
            rest = sum(int(self.impact[p[0]]) * p[2] for p in left)
            seen = np.flatnonzero(sums)
            if len(seen) >= k:
                bar = int(np.partition(sums[seen], len(seen) - k)[len(seen) - k])
                if rest < bar:  # no other document can come to the k-th sum
                    break
        some = seen[sums[seen] + rest >= bar]
        scores = self._complete(some, terms, w) if left else sums[some]
        some, scores = some[scores > 0], scores[scores > 0]
        best = np.lexsort((self.docs[some], -scores))[:k]
        return some[best], scores[best]

    def _complete(self, some: np.ndarray, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Whole scores of the documents at ``some``, from their own terms."""
        weight = np.zeros(int(max(self.terms[-1], terms.max())) + 1, np.int64)
        weight[terms] = w
        n = self.first[some + 1] - self.first[some]
        at = np.repeat(self.first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        got = weight[self.by_doc[0][at]] * self.by_doc[1][at]
        return np.add.reduceat(np.r_[got, 0], np.cumsum(n) - n) * (n > 0)


def _search(vocabulary, queries, total: tuple[int, int], k: int):
    """Shards over rows (doc_id, n, terms, counts); rows (place, doc_id, score) of the
    ``k`` best of each. ``vocabulary``: sorted terms and their weights, ``queries``:
    places, first and last of their pairs, terms as places in the vocabulary."""

    def run(batches):
        terms, weights = vocabulary.value
        places, first, own = queries.value

        def out(parts):
            docs, sizes, lengths, term, tf = (np.concatenate(x) for x in zip(*parts))
            shard = Shard(docs, sizes, lengths, term, tf, total)
            made = [(p, *shard.top(own[a:b], weights[own[a:b]], k)) for p, a, b in zip(places, first, first[1:])]
            at = np.concatenate([x[1] for x in made])
            score = np.concatenate([x[2] for x in made])
            place = np.repeat(places, [len(x[1]) for x in made])
            ids = docs[at]
            return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(score, pa.int64())], ["place", "doc_id", "score"])

        parts, n_docs, n_postings = [], 0, 0
        for batch in batches:
            for z in range(0, batch.num_rows, 1000):
                part = batch.slice(z, 1000)
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                lists, counts = part.column(2), part.column(3)
                lengths = np.diff(lists.offsets.to_numpy())
                found, tf = lists.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
                at = np.searchsorted(terms, found)
                known = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == found)
                owner = np.repeat(np.arange(len(lengths)), lengths)[known]
                lengths = np.bincount(owner, minlength=len(lengths))
                some = lengths > 0
                parts.append((ids[some], part.column(1).to_numpy(zero_copy_only=False)[some], lengths[some], at[known], tf[known]))
                n_docs, n_postings = n_docs + int(some.sum()), n_postings + len(owner)
                if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                    yield out(parts)
                    parts, n_docs, n_postings = [], 0, 0
                    trim()
        if n_docs:
            yield out(parts)
        trim()

    return run


#: Stands for a null id: behind all others.
_NO_ID = 2**63 - 1


def _blocks(pairs: DataFrame):
    """The rows of ``pairs`` in blocks of whole queries and some BLOCK rows, each with
    its number of rows. ``pairs`` is written."""
    n = pairs.count()
    cuts = -(-n // BLOCK)
    for k in range(cuts):
        yield pairs if cuts == 1 else pairs.where(F.pmod(F.xxhash64("place"), F.lit(cuts)) == k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``queries`` the ``k`` rows of
    ``docs`` with the highest scores above 0, all if they are fewer.

    Equal scores go by ascending doc_id, a null id last. Each row of ``docs`` is a
    document, repeated rows too, and each row of ``queries`` a query, ranked for
    itself; null, empty and termless texts have no terms, so such documents count
    neither as documents nor as results, and such queries give no rows; an empty table
    gives an empty table; other columns play no part."""
    spark = docs.sparkSession
    pairs = materialise(query_terms(queries, item_col, text), "queries")
    vocabulary = pairs.select("term").distinct()
    few = vocabulary.count() <= VOCABULARY
    index = index_terms(docs, {r["term"] for r in vocabulary.toLocalIterator()} if few else None, id_col, text)
    total = corpus_size(index)
    weights = materialise(term_weights(index, total[0]), "weights")
    tops = []
    for block in _blocks(pairs):
        rows = block.join(weights, "term").select("place", "term", "w").toPandas().sort_values(["place", "term"])
        if not len(rows):
            continue
        terms, own = np.unique(rows["term"].to_numpy(np.int64), return_inverse=True)
        w = np.zeros(len(terms), np.int64)
        w[own] = rows["w"].to_numpy(np.int64)
        places, first = np.unique(rows["place"].to_numpy(np.int64), return_index=True)
        sent = spark.sparkContext.broadcast((terms, w)), spark.sparkContext.broadcast((places, np.r_[first, len(rows)], own))
        tops.append(index.mapInArrow(_search(*sent, total, k), "place long, doc_id long, score long"))
    if not tops:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = tops[0]
    for more in tops[1:]:
        every = every.union(more)
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(pairs.select("place", "item_id").distinct(), "place").select("item_id", "rank", "doc_id", "score")

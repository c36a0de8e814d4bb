"""Benchmark decontamination by a positional inverted index over the documents.

The index holds a posting (document, place, term) for each occurrence of a test
term, and one of an end mark behind each document's last word. It is written
once, in document order and without a shuffle; its terms are numbers of the test
vocabulary. A phrase is looked up by its rarest term first: postings of that
term, moved back by the term's place in the phrase, give starts; the second
rarest term's list is intersected with them; the starts left are checked term by
term against the postings of the documents that have a start. DataFrame functions
only.

What comes from the test items (vocabulary, windows) is broadcast up to
BROADCAST_ROWS rows, counted before, and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.keys import MAY, NO_ID, flagged, key_hash, mark_of, without
from studyloom.llm.storage import materialise

WINDOW = 10
#: Rows of test vocabulary or windows that may be broadcast: some 50 MB at most.
BROADCAST_ROWS = 500_000
#: What separates words: ASCII without digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Fixed values.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term of the mark behind a document's last word.
END = 0


def words_of(text: Column) -> Column:
    """Words of a text in order, not lower-cased; null has none. An empty string
    stands before or behind where the text starts or ends with a gap."""
    return F.split(F.coalesce(text, F.lit("")), GAP, -1)


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, _UPPER, _LOWER)).otherwise(word)


def windows(items: DataFrame, id_col: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, words, item_ids) of all distinct windows; an item of fewer words, but
    not none, is one window. ``window`` numbers are hashes of the words."""
    words = F.filter(words_of(F.col(text)), lambda w: w != "")
    rows = items.select(F.col(id_col).alias("item_id"), F.transform(words, lowered).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = rows.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(F.xxhash64("words").alias("window"), "words", "item_ids")


def small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are few. Give it written tables."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def vocabulary(wins: DataFrame) -> DataFrame:
    """(word, term): numbers from 1 on for the words of the windows, END for the mark.
    Numbers are those of rows in a written table, so no task sees all words."""
    words = materialise(wins.select(F.explode("words").alias("word")).distinct(), "words")
    mark = wins.sparkSession.range(1).select(F.lit("\n").alias("word"), F.lit(END).cast("long").alias("term"))
    return materialise(words.select("word", (F.monotonically_increasing_id() + 1).alias("term")).union(mark), "vocabulary")


def postings(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, pos, term) of all rows of ``docs``, written to the shared folder;
    ``mark`` is a hash of the text, which keeps rows of one id apart."""
    t = F.col(text)
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc_id"), mark_of(t).alias("mark"), words_of(t).alias("w"))
    lead = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    rows = rows.select("doc_id", "mark", lead.alias("lead"), F.concat(F.slice("w", 1, F.size("w") - tail), F.array(F.lit("\n"))).alias("w"))
    each = rows.select("doc_id", "mark", "lead", F.posexplode("w").alias("pos", "word"))
    each = each.select("doc_id", "mark", (F.col("pos") - F.col("lead")).alias("pos"), lowered(F.col("word")).alias("word"))
    return materialise(each.join(small(vocab), "word").select("doc_id", "mark", "pos", "term"), "postings")


def once(index: DataFrame) -> DataFrame:
    """``index`` with the postings of repeated rows (equal id and text) only once.
    Repeated rows show by their end marks; only their postings are dealt out."""
    doc = ["doc_id", "mark"]
    again = index.where(F.col("term") == END).groupBy(*doc).agg(F.count("*").alias("n")).where("n > 1").select(*doc)
    if not again.take(1):
        return index
    again = materialise(again, "again")
    single = index.join(again, doc, "left_semi").distinct()
    return materialise(index.join(again, doc, "left_anti").union(single), "postings")


def build_index(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of the distinct rows of ``docs``."""
    return once(postings(docs, vocab, id_col, text))


def _ranked_terms(wins: DataFrame, vocab: DataFrame, index: DataFrame) -> DataFrame:
    """(window, size, rank, term, at): the terms of each window by how often they
    occur in the documents, the rarest first; ``at`` is the place in the window."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    places = wins.select("window", F.size("words").alias("size"), F.posexplode("words").alias("at", "word")).join(vocab, "word")
    known = places.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("window").orderBy("n", "term", "at")
    return known.select("window", "size", (F.row_number().over(order) - 1).alias("rank"), "term", "at", "n")


def find_phrases(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, mark, start, window, size) of every occurrence of every window.

    ``ranked`` has a few rows for each window. Starts come from the rarest term
    alone, so their number is bounded by the rarest lists. Only postings of
    documents with a start are dealt out (a bitmap of these finds them); they
    meet the starts on (document, place, term), which spreads evenly however
    often a word or passage occurs."""
    of = lambda rank, *columns: small(ranked.where(rank).select("term", "window", "at", *columns))
    heads = index.join(of("rank = 0 and n > 0", "size"), "term")
    starts = heads.select("doc_id", "mark", (F.col("pos") - F.col("at")).alias("start"), "window", "size").where("start >= 0")
    seconds = index.join(of("rank = 1"), "term").select("doc_id", "mark", (F.col("pos") - F.col("at")).alias("start"), "window")
    keys = ["doc_id", "mark", "start", "window"]
    one = starts.where("size = 1")
    both = starts.where("size > 1").join(seconds, keys, "left_semi")
    both = materialise(both, "starts")
    rest = small(ranked.where("rank > 1").select("window", "term", "at"))
    asked = both.where("size > 2").join(rest, "window").select(*keys, "size", (F.col("start") + F.col("at")).alias("pos"), "term")
    doc = key_hash(F.col("doc_id"), F.col("mark"))
    near = flagged(index, doc, both.where("size > 2").select("doc_id", "mark").distinct(), doc).where(MAY).drop(MAY)
    seen = asked.hint("shuffle_hash").join(near, ["doc_id", "mark", "pos", "term"])
    full = seen.groupBy(*keys, "size").agg(F.count("*").alias("got")).where(F.col("got") == F.col("size") - 2)
    cols = [*keys, "size"]
    return one.select(cols).union(both.where("size = 2").select(cols)).union(full.select(cols))


def find_near(index: DataFrame, vocab: DataFrame, phrases: DataFrame, slack: int) -> DataFrame:
    """(doc_id, mark, phrase, start, width): proximity matches. A phrase matches
    where all its distinct words lie within ``width`` <= number of words + slack.

    ``phrases`` has (phrase, words). Postings of the rarest word anchor the search;
    postings of the other words within reach are counted by distinct word."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    terms = phrases.select("phrase", F.size(F.array_distinct("words")).alias("need"), F.explode(F.array_distinct("words")).alias("word")).join(vocab, "word", "left")
    terms = terms.join(counts, "term", "left")
    order = Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "term")
    ranked = terms.withColumn("rank", F.row_number().over(order))
    reach = F.col("need") + slack
    anchors = index.join(ranked.where("rank = 1"), "term").select("doc_id", "mark", "phrase", "need", F.col("pos").alias("anchor"))
    # windows that hold the anchor start at most reach - 1 before it
    starts = anchors.select("doc_id", "mark", "phrase", "need", F.explode(F.sequence(F.greatest(F.col("anchor") - reach + 1, F.lit(0)), F.col("anchor"))).alias("start")).distinct()
    asked = starts.join(ranked.select("phrase", "term"), "phrase")
    spread = asked.select("doc_id", "mark", "phrase", "need", "start", "term", F.explode(F.sequence(F.col("start"), F.col("start") + reach - 1)).alias("pos"))
    got = spread.join(index, ["doc_id", "mark", "pos", "term"]).groupBy("doc_id", "mark", "phrase", "need", "start", "term").agg(F.min("pos").alias("pos"))
    full = got.groupBy("doc_id", "mark", "phrase", "need", "start").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    full = full.where((F.col("n") == F.col("need")) & (F.col("a") == F.col("start")))
    return full.select("doc_id", "mark", "phrase", "start", (F.col("b") - F.col("a") + 1).alias("width"))


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, item_ids) of every row of ``docs``; ids are whole
    numbers or null.

    ``n_hit`` counts words inside any occurrence of a window: occurrences are
    merged as intervals, so shared words count once. Null, empty and wordless
    texts have no words and no hits; items without words have no windows; repeated
    rows stay repeated, with equal results, and rows that share an id but not the
    text have each their own; an empty table gives an empty table; without items
    nothing is hit. Other columns are left out."""
    wins = materialise(windows(items, text=text, size=size), "windows")
    vocab = vocabulary(wins)
    every_row = postings(docs, vocab, id_col, text)
    index = once(every_row)
    ranked = materialise(_ranked_terms(wins, vocab, index), "ranked")
    found = materialise(find_phrases(index, ranked).distinct(), "hits")
    doc = ["doc_id", "mark"]
    per_start = found.groupBy(*doc, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    order = Window.partitionBy(*doc).orderBy("start")
    past = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = per_start.select(*doc, F.greatest(F.col("end") - F.greatest(F.col("start"), past), F.lit(0)).alias("n"))
    n_hit = covered.groupBy(*doc).agg(F.sum("n").alias("n_hit"))
    by_item = found.select(*doc, "window").distinct().join(wins.select("window", "item_ids"), "window")
    items_of = by_item.select(*doc, F.explode("item_ids").alias("item")).groupBy(*doc).agg(F.collect_set("item").alias("item_ids"))
    ends = every_row.where(F.col("term") == END).select(*doc, F.col("pos").cast("long").alias("n_words"))
    every = ends.join(materialise(n_hit.join(items_of, doc), "marked"), doc, "left")
    own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return every.select(own, "mark", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without any occurrence of a window of ``items``.

    Rows with null or wordless text stay; equal rows share their fate; empty
    tables give empty or unchanged tables; other columns are kept as they are."""
    bad = materialise(hits(docs, items, id_col, text).where("n_hit > 0").select("doc_id", "mark"), "hit")
    return without(docs, bad, id_col, mark_of(F.col(text)))

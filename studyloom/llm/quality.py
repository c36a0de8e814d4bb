"""Quality rules whose thresholds come from quantile sketches of each language and source.

A sketch is a histogram over bins of constant relative width (ratio GAMMA), so
two sketches merge by adding counts: exactly, in any order and after any retry.
Its quantiles are within ACCURACY of the value. Sketches of (lang, source) add
up to sketches of lang and of everything, which stand in for small groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.keys import without
from studyloom.llm.storage import materialise, packed, unpacked
from studyloom.llm.text_stats import add_stats, text_stats

ACCURACY = 0.02
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Values up to this count as zero, in a bin of their own.
LEAST = 1e-4
ZERO_BIN = -1000
#: Groups with fewer documents take the thresholds of their language, small
#: languages those of all documents.
MIN_DOCS = 100
#: A text fails if a measure exceeds median + SPREADS * max(median - lower decile, slack).
#: The lower half of a distribution is what junk does not stretch.
SPREADS = 6.0
SLACK = {"symbol_rate": 0.03, "upper_rate": 0.04, "repeat_rate": 0.06}
#: The threshold of a group is at most so many times that of its language, so a
#: source that is junk for the most part can't vouch for itself.
PARENT = 2.0
MIN_WORDS = 50
MAX_REPEAT = 0.5


def measures(s: str = "stats") -> dict[str, Column]:
    """Rates that the rules look at; 0 where there is nothing to divide by."""
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f = lambda name: F.col(f"{s}.{name}").cast("double")
    return {
        "symbol_rate": rate(f("n_symbols"), f("n_words")),
        "upper_rate": rate(f("n_upper"), f("n_upper") + f("n_lower")),
        "repeat_rate": rate(f("n_repeat_words"), f("n_words")),
    }


def bin_of(value: Column) -> Column:
    return F.when(value > LEAST, F.ceil(F.log(value) / math.log(GAMMA)).cast("int")).otherwise(F.lit(ZERO_BIN))


def value_of(bin_: Column) -> Column:
    return F.when(bin_ > ZERO_BIN, 2 * F.pow(F.lit(GAMMA), bin_) / (GAMMA + 1)).otherwise(F.lit(0.0))


def sketches(docs: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bin, n) of documents with stats, counted
    before the shuffle. level 2: lang and source, 1: lang, 0: all."""
    parts = [F.struct(F.lit(k).alias("measure"), bin_of(v).alias("bin")) for k, v in measures().items()]
    cells = docs.select("lang", "source", F.explode(F.array(*parts)).alias("c")).groupBy("lang", "source", "c.measure", "c.bin").agg(F.count("*").alias("n"))
    merged = lambda level, lang, source: cells.groupBy(lang.alias("lang"), source.alias("source"), "measure", "bin").agg(F.sum("n").alias("n")).withColumn("level", F.lit(level))
    none = F.lit(None).cast("string")
    return merged(2, F.col("lang"), F.col("source")).unionByName(merged(1, F.col("lang"), none)).unionByName(merged(0, none, none))


def quantiles(cells: DataFrame, points: dict[str, float]) -> DataFrame:
    """Quantiles of each sketch: one row per (level, lang, source, measure)."""
    keys = ["level", "lang", "source", "measure"]
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    seen = cells.select(*keys, "bin", "n", upto.alias("upto"), F.sum("n").over(group).alias("total"))
    rank = lambda q: F.floor((F.col("total") - 1) * q) + 1
    return seen.groupBy(*keys).agg(F.first("total").alias("total"), *[value_of(F.min(F.when(F.col("upto") >= rank(q), F.col("bin")))).alias(k) for k, q in points.items()])


def thresholds(docs: DataFrame) -> DataFrame:
    """(lang, source, <measure>_max...) for each lang and source of documents with
    stats. Null lang or source is a group of its own."""
    q = quantiles(materialise(sketches(docs), "sketches"), {"low": 0.1, "mid": 0.5})
    slack = F.create_map(*[x for k, v in SLACK.items() for x in (F.lit(k), F.lit(v))])[F.col("measure")]
    q = q.withColumn("most", F.col("mid") + SPREADS * F.greatest(F.col("mid") - F.col("low"), slack)).select("level", "lang", "source", "measure", "total", "most")
    wide = lambda level, *keys: q.where(F.col("level") == level).groupBy(*keys).agg(F.max("total").alias(f"n{level}"), *[F.max(F.when(F.col("measure") == k, F.col("most"))).alias(f"{k}_{level}") for k in SLACK])
    own, lang, every = wide(2, "lang", "source"), wide(1, "lang").withColumnRenamed("lang", "l"), wide(0)
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    whole = every.first() or {}  # one row, none for an empty table
    pick = lambda k: F.least(F.when(F.col("n2") >= MIN_DOCS, F.col(f"{k}_2")).otherwise(up(k)), PARENT * up(k))
    up = lambda k: F.when(F.col("n1") >= MIN_DOCS, F.col(f"{k}_1")).otherwise(F.lit(whole[f"{k}_0"] if whole else 0.0))
    return joined.select("lang", "source", *[pick(k).alias(f"{k}_max") for k in SLACK])


def apply_rules(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """``docs`` with stats, and base_failed, failed (names of the measures over
    their threshold) and kept. Thresholds join on lang and source; they are few
    rows, and Spark broadcasts them if they are small enough, else it shuffles
    and splits skewed groups."""
    lim = limits.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[c for c in limits.columns if c.endswith("_max")])
    rows = packed(docs, "lang", "source", "stats")
    joined = rows.join(lim, rows["lang"].eqNullSafe(lim["of_lang"]) & rows["source"].eqNullSafe(lim["of_source"]), "left")
    s = F.col("stats")
    base = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 100 * MAX_REPEAT * s["n_words"])
    over = [F.when(v > F.col(f"{k}_max"), F.lit(k)) for k, v in measures().items()]
    failed = F.array_compact(F.array(*over))
    own = unpacked(docs.columns, "base_failed", "failed", "kept")
    return joined.select(*own, base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with stats, base_failed, failed and kept.

    Null text has no words and fails. Null lang or source is a group of its own.
    Repeated rows count as often as they occur and stay repeated; an empty table
    gives an empty table. Columns of ``docs`` with the new names are replaced.
    Thresholds are computed over all documents and written to the shared folder,
    then the documents are read once more."""
    rated = add_stats(docs, text)
    limits = materialise(thresholds(rated.select("lang", "source", "stats")), "thresholds")
    return apply_rules(rated, limits)


def rated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, lang, source, stats, base_failed, failed, kept) of every row;
    ``mark`` is a hash of text, lang and source. Texts are read once: their
    statistics are written, and thresholds and verdicts come from these."""
    mark = F.xxhash64(text, "lang", "source")
    narrow = materialise(docs.select(F.col(id_col).alias("doc_id"), mark.alias("mark"), "lang", "source", text_stats(F.col(text)).alias("stats")), "stats")
    return apply_rules(narrow, materialise(thresholds(narrow), "thresholds"))


def drop_failing(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are;
    odd rows are treated as in ``quality_rules``."""
    bad = materialise(rated(docs, id_col, text).where("not kept").select("doc_id", "mark").distinct(), "failing")
    return without(docs, bad, id_col, F.xxhash64(text, "lang", "source"))

"""From raw documents to token ids: quality rules, near-duplicates, benchmark
decontamination, secrets, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import decontam, near_copies, pieces, quality, secrets
from studyloom.llm.memory import small_batches
from studyloom.llm.queries import table, tokenizer
from studyloom.llm.storage import materialise, release, written

MODEL = "piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    small_batches(spark)
    return quality.drop_failing(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8 or more; close
    pairs come from the SimHash anchors) the document with the least id."""
    small_batches(spark)
    return near_copies.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars counts the new text."""
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("row"))
    clean = secrets.find_secrets(rows).withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    size = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": size}
    return clean.select(*[new.get(c.lower(), F.col("row")[c]).alias(c) for c in docs.columns])


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids, their number, and the text that the ids decode to
    in place of the text; columns of those names give way, all others stay."""
    small_batches(spark)
    coded = pieces.encode_documents(docs, tokenizer(MODEL))
    new = ("text", "ids", "n_tokens", "decoded")
    return coded.select(*[coded[c] for c in docs.columns if c.lower() not in new], "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").alias("text"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("pieces", piece_stage),
]

#: SQL has neither the fingerprints nor the merges; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way is deleted when its
    own table stands."""
    docs = table(spark, sf_dir, "documents")
    begun = written()
    try:
        for k, (name, stage) in enumerate(STAGES):
            mark = written()
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = materialise(docs, f"stage-{k}")
                release(spark, mark, but_last=True)
    except Exception:
        release(spark, begun)
        raise
    return docs

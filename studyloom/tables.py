"""A folder of table files to analyses in one call, without a review around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.functions import prompts
from studyloom.operators import models
from studyloom.sources import files, sinks
from studyloom.streaming.journal import Journal


def parse_folder(spark: SparkSession, folder: str, client: models.ModelClient, out: str, info: str | None = None) -> DataFrame:
    """Ask the model about every table below ``folder`` and write its answers by table
    below ``out``, and all of them to ``all_results.json``. Returns the analyses
    (table_id, pos, name, description, points), one row each.

    ``info`` is a CSV file of captions and feet by ``table_data_file``. Answers are
    journalled: a call that follows a failed one asks about the rest only. A table whose
    answer can't be read has null as its result and no analyses."""
    known = files.csv(spark, info) if info else None
    rows = files.table_files(spark, folder, known)
    column = lambda c: F.col(c) if c in rows.columns else F.lit("")
    asked = rows.select("table_id", prompts.table(column("table_caption"), column("table_foot"), F.col("raw_table")).alias("prompt"))
    requests = asked.select(F.lit("tables").alias("task"), F.col("table_id").alias("study_id"), F.col("table_id").alias("item_id"), "prompt")
    answers = models.ask(client, requests, lambda df, _: df, "tables", journal=Journal(spark, f"{out.rstrip('/')}/journal"))
    whole = F.from_json("payload", models.ANALYSES)
    sound = answers.select(F.col("item_id").alias("table_id"), F.when(whole["analyses"].isNotNull(), F.col("payload")).alias("payload"))
    sinks.by_table(sound, out.rstrip("/"))
    parsed = models.parse_tables(asked.select(F.col("table_id").alias("pmid"), F.lit(0).alias("table_pos"), "table_id", F.col("prompt").alias("raw_table")), Stored(spark, out))
    return parsed.select("table_id", "pos", "name", "description", "points")


class Stored(models.ModelClient):
    """Answers from what ``sinks.by_table`` has written."""

    paid = False

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def respond(self, requests: DataFrame) -> DataFrame:
        rows = self.spark.read.schema("value string, table_id string").text(f"{self.out}/tables", wholetext=True)
        stored = rows.select(F.col("table_id").alias("item_id"), F.rtrim("value").alias("payload")).where("payload <> 'null'")
        return requests.select("task", "study_id", "item_id").join(stored, "item_id", "left").select("task", "study_id", "item_id", F.lit(1).alias("attempt"), "payload")

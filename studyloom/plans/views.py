"""The driver's tables in the parts of a review: studies, responses, foci, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.functions import status as st
from studyloom.operators import retrieval, screening

THRESHOLD = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("pmid"), F.col("doc_id").alias("pos"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.col("source").alias("journal"),
        F.lit(st.PENDING).alias("status"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1_000_000).alias("pmcid"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.col("doc_id").cast("string").alias("study_id"), F.when(F.col("quality") == 1, "INCLUDED").otherwise("EXCLUDED").alias("decision"),
        (F.col("doc_id") % 100 / 100.0).cast("double").alias("confidence"), F.lit("because").alias("reason"), (F.col("toxic") == 1).alias("fulltext_incomplete"),
    )


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies after both stages; every second included study has a full text."""
    rows, answers = studies(spark, sf_dir), responses(spark, sf_dir)
    todo = screening.with_abstract(screening.pending(rows)).select("pmid")
    first = screening.process_responses(answers.join(todo, answers["study_id"] == todo["pmid"], "left_semi"), "abstract", True, THRESHOLD)
    rows = screening.apply_results(rows.drop("abstract"), first, "abstract")
    rows = retrieval.in_scope(rows, load_excluded=True)
    rows = rows.withColumn("fulltext_available", F.col("pos") % 2 == 0).withColumn("full_text_path", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("/texts/"), F.col("pmid")))).withColumn("full_text_source", F.when(F.col("pos") % 2 == 0, F.lit("local")))
    ready = screening.ready_for_fulltext(rows).select("pmid")
    second = screening.process_responses(answers.join(ready, answers["study_id"] == ready["pmid"], "left_semi"), "fulltext")
    return screening.apply_results(rows, second, "fulltext")


def foci(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return e.select(
        F.col("user_id").alias("study"), F.col("event_type").alias("table_id"), F.concat(F.lit("label "), (F.col("event_id") % 7).cast("string")).alias("table_label"), F.col("event_id").alias("row_pos"),
        (F.col("value") - 50).alias("x"), (k - 50).alias("y"), (F.col("event_id") % 91 - 45).cast("double").alias("z"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    analysis = F.concat(F.col("user_id").cast("string"), F.lit("_analysis_"), (F.col("event_id") % 3).cast("string"))
    return e.select(F.col("user_id").cast("string").alias("study_id"), analysis.alias("analysis_id"), F.col("event_type").alias("annotation_name"), (F.col("value") > 34).alias("include"), F.col("event_id").alias("pos"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations(spark, sf_dir).select("study_id", "analysis_id").distinct()


# The same views in DuckDB.
SQL = {
    "v_resp": "SELECT CAST(doc_id AS VARCHAR) AS study_id, CASE WHEN quality = 1 THEN 'INCLUDED' ELSE 'EXCLUDED' END AS decision, (doc_id % 100) / 100.0::DOUBLE AS confidence, toxic = 1 AS incomplete FROM labels",
    "v_abs": """SELECT d.doc_id, CASE WHEN r.study_id IS NULL OR NOT regexp_matches(coalesce(d.text, ''), '\\S') THEN 'pending'
      WHEN r.confidence >= 0.2 AND r.decision = 'INCLUDED' THEN 'included_abstract' ELSE 'excluded_abstract' END AS status FROM documents d LEFT JOIN v_resp r ON r.study_id = CAST(d.doc_id AS VARCHAR)""",
    "v_studies": """SELECT a.doc_id AS pos, CAST(a.doc_id AS VARCHAR) AS pmid, a.status AS abstract_status,
      CASE WHEN a.status = 'included_abstract' AND a.doc_id % 2 = 0 AND r.study_id IS NOT NULL THEN CASE WHEN r.incomplete THEN 'fulltext_incomplete' WHEN r.decision = 'INCLUDED' THEN 'included_fulltext' ELSE 'excluded_fulltext' END ELSE a.status END AS status,
      CASE WHEN a.doc_id % 3 = 0 THEN a.doc_id + 1000000 END AS pmcid, a.doc_id % 2 = 0 AS fulltext_available, CASE WHEN a.doc_id % 4 = 0 THEN '/texts/' || a.doc_id END AS full_text_path,
      a.status IN ('included_abstract', 'excluded_abstract') AS retrieval_in_scope, CASE WHEN a.status IN ('included_abstract', 'excluded_abstract') THEN a.status = 'included_abstract' END AS in_included_set
      FROM v_abs a LEFT JOIN v_resp r ON r.study_id = CAST(a.doc_id AS VARCHAR)""",
    "v_foci": "SELECT user_id AS study, event_type AS table_id, 'label ' || (event_id % 7) AS table_label, event_id AS row_pos, value - 50 AS x, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50 AS y, CAST(event_id % 91 - 45 AS DOUBLE) AS z FROM events",
    "v_ann": "SELECT CAST(user_id AS VARCHAR) AS study_id, user_id || '_analysis_' || (event_id % 3) AS analysis_id, event_type AS annotation_name, value > 34 AS include, event_id AS pos FROM events",
}
NEEDS = {"v_abs": ("v_resp",), "v_studies": ("v_resp", "v_abs")}


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the definitions of the views it names and of those they need."""
    order = [n for n in SQL if n in {*names, *(x for n in names for x in NEEDS.get(n, ()))}]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + sql

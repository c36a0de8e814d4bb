"""Counts and reports over the studies relation: one pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.functions import status as st


def prisma_counts(studies: DataFrame) -> DataFrame:
    """Flow counts: failed studies count as screened."""
    s = F.col("status")
    return studies.agg(
        F.count("*").alias("total_identified"), F.count_if(s != st.PENDING).alias("abstract_screened"), F.count_if(s == st.EXCLUDED_ABSTRACT).alias("abstract_excluded"),
        F.count_if(s.isin(st.INCLUDED_FULLTEXT, st.EXCLUDED_FULLTEXT, st.FULLTEXT_INCOMPLETE)).alias("fulltext_assessed"),
        F.count_if(s == st.EXCLUDED_FULLTEXT).alias("fulltext_excluded"), F.count_if(s == st.FULLTEXT_INCOMPLETE).alias("fulltext_incomplete"),
        F.count_if(s == st.INCLUDED_FULLTEXT).alias("final_included"),
    )


def summary_counts(studies: DataFrame) -> DataFrame:
    """Counts of the console summary."""
    s = F.col("status")
    later = [st.INCLUDED_FULLTEXT, st.EXCLUDED_FULLTEXT, st.FULLTEXT_INCOMPLETE]
    return studies.agg(
        F.count("*").alias("found"), F.count_if(s != st.PENDING).alias("abstract_screened"), F.count_if(s.isin(st.INCLUDED_ABSTRACT, *later)).alias("included_after_abstract"),
        F.count_if(s == st.EXCLUDED_ABSTRACT).alias("excluded_at_abstract"), F.count_if(s.isin(*later)).alias("fulltext_screened"),
        F.count_if(s == st.FULLTEXT_INCOMPLETE).alias("fulltext_incomplete"), F.count_if(s == st.INCLUDED_FULLTEXT).alias("included"),
    )


def run_statistics(studies: DataFrame) -> DataFrame:
    s = F.col("status")
    return studies.agg(
        F.count("*").alias("total_studies"), F.count_if(s == st.INCLUDED_FULLTEXT).alias("included_studies"),
        F.count_if(s.isin(st.EXCLUDED_ABSTRACT, st.EXCLUDED_FULLTEXT)).alias("excluded_studies"), F.count_if(s == st.PENDING).alias("pending_studies"),
    )


def missing_fulltexts(studies: DataFrame, output_dir: str) -> DataFrame:
    """Unavailable and incomplete full texts, by type and pmid."""
    incomplete = F.col("status") == st.FULLTEXT_INCOMPLETE
    unavailable = F.coalesce("retrieval_in_scope", F.lit(False)) & ~F.coalesce("fulltext_available", F.lit(False)) & ~incomplete
    fallback = F.when(incomplete & F.col("pmcid").isNotNull(), F.concat(F.lit(f"{output_dir}/retrieval/pubget_data/text.csv [pmcid="), F.col("pmcid").cast("string"), F.lit("]")))
    rows = studies.select(
        "pmid", F.when(incomplete, "incomplete").when(unavailable, "unavailable").alias("type"), F.coalesce("full_text_source", F.lit("")).alias("source"),
        F.coalesce(F.nullif("full_text_path", F.lit("")), fallback, F.lit("")).alias("full_text_path"),
        F.coalesce("in_included_set", F.col("status") == st.INCLUDED_ABSTRACT).alias("in_included_set"),
    )
    return rows.where(F.col("type").isNotNull()).orderBy("type", "pmid")


def total_analyses(studies: DataFrame) -> DataFrame:
    return studies.agg(F.coalesce(F.sum(F.coalesce(F.size("analyses"), F.lit(0))), F.lit(0)).alias("total_analyses"))

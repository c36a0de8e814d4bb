"""Screening: who is screened, what is cached, what the model says, what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions import status as st
from studyloom.functions.text import filled
from studyloom.operators.relational import last_by


def pending(studies: DataFrame) -> DataFrame:
    return studies.where(F.col("status") == st.PENDING)


def with_abstract(studies: DataFrame) -> DataFrame:
    return studies.where(filled(F.col("abstract")))


def screenable(studies: DataFrame, stage: str) -> DataFrame:
    """Studies that a stage can look at. For full texts something must point to a text."""
    if stage == "abstract":
        return with_abstract(studies)
    text = F.coalesce("fulltext_available", F.lit(False)) | F.coalesce(F.col("full_text_path") != "", F.lit(False)) | F.col("pmcid").isNotNull()
    return studies.where(text & (F.col("status") == st.INCLUDED_ABSTRACT))


def ready_for_fulltext(studies: DataFrame) -> DataFrame:
    return studies.where(F.coalesce("fulltext_available", F.lit(False)) & (F.col("status") == st.INCLUDED_ABSTRACT))


def cache_split(studies: DataFrame, results: DataFrame, stage: str, force_incomplete: bool = False, retry_failed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cached, to do). ``cached`` has the state its stored decision leads to. Of
    several decisions of a study the last one by ``pos`` counts, if there is a pos."""
    stored = results.where(F.col("screening_type") == stage) if "screening_type" in results.columns else results
    if "pos" in stored.columns:
        stored = last_by(stored, ["study_id"], "pos").drop("pos")
    state = st.cached_state(F.col("decision"), stage)
    if force_incomplete and stage == "fulltext":
        state = F.when(state != st.FULLTEXT_INCOMPLETE, state)
    if retry_failed:
        state = F.when(state != st.SCREENING_FAILED, state)
    known = stored.select(F.col("study_id").alias("pmid"), state.alias("cached_status"), F.col("reason").alias("cached_reason"), F.col("confidence").alias("cached_confidence"))
    joined = studies.join(known, "pmid", "left")
    found = F.col("cached_status").isNotNull()
    return joined.where(found), joined.where(~found).drop("cached_status", "cached_reason", "cached_confidence")


def process_responses(responses: DataFrame, stage: str, reporting: bool = False, threshold: float | None = None) -> DataFrame:
    """Screening rows of model responses (study_id, decision, confidence, reason,
    fulltext_incomplete, ...) after the confidence rule; a null decision is a failure."""
    incomplete = F.col("fulltext_incomplete") if "fulltext_incomplete" in responses.columns else F.lit(False)
    ruled = st.with_threshold(F.col("decision"), F.col("confidence"), incomplete, stage, reporting, threshold)
    turned = st.below_threshold(F.col("confidence"), reporting, threshold) & (ruled == "EXCLUDED")
    decision = st.decided(stage, F.coalesce(ruled, F.lit("SCREENING_FAILED")))
    out = responses.withColumn("_ruled", decision).withColumn("_turned", turned)
    reason = F.col("reason")
    if reporting and threshold is not None:
        reason = F.when(F.col("_turned"), st.threshold_reason(F.col("reason"), F.col("confidence"), threshold)).otherwise(F.col("reason"))
    out = out.withColumn("reason", reason).withColumn("confidence", F.when(F.col("_ruled") == st.SCREENING_FAILED, F.lit(0.0)).otherwise(F.col("confidence")))
    return out.withColumn("decision", F.col("_ruled")).withColumn("screening_type", F.lit(stage)).drop("_ruled", "_turned", "fulltext_incomplete")


def apply_results(studies: DataFrame, results: DataFrame, stage: str) -> DataFrame:
    """Studies with state, reason and score of their result; others unchanged."""
    new = results.select(F.col("study_id").alias("pmid"), F.col("decision").alias("_status"), F.col("reason").alias("_reason"), F.col("confidence").alias("_score"))
    joined = studies.join(new, "pmid", "left")
    out = joined.withColumn("status", F.coalesce("_status", "status"))
    for name, column in ((f"{stage}_screening_reason", "_reason"), (f"{stage}_screening_score", "_score")):
        out = out.withColumn(name, F.coalesce(column, name) if name in studies.columns else F.col(column))
    return out.drop("_status", "_reason", "_score")


def skip_stage(studies: DataFrame, stage: str) -> DataFrame:
    return studies.withColumn("status", st.promoted(F.col("status"), stage))


def tally(results: DataFrame) -> DataFrame:
    """One row: included, excluded, incomplete, failed."""
    d = F.col("decision")
    count = lambda c: F.count_if(c)
    return results.agg(
        count(d.isin(st.INCLUDED_ABSTRACT, st.INCLUDED_FULLTEXT)).alias("included"), count(d.isin(st.EXCLUDED_ABSTRACT, st.EXCLUDED_FULLTEXT)).alias("excluded"),
        count(d == st.FULLTEXT_INCOMPLETE).alias("incomplete"), count(d == st.SCREENING_FAILED).alias("failed"),
    )


def truth(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))

"""The states of a study and the rules that move it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.functions.text import strip

PENDING, SCREENING_FAILED, RETRIEVAL_FAILED = "pending", "screening_failed", "retrieval_failed"
INCLUDED_ABSTRACT, EXCLUDED_ABSTRACT = "included_abstract", "excluded_abstract"
INCLUDED_FULLTEXT, EXCLUDED_FULLTEXT, FULLTEXT_INCOMPLETE = "included_fulltext", "excluded_fulltext", "fulltext_incomplete"
STATES = (PENDING, INCLUDED_ABSTRACT, EXCLUDED_ABSTRACT, INCLUDED_FULLTEXT, EXCLUDED_FULLTEXT, FULLTEXT_INCOMPLETE, RETRIEVAL_FAILED, SCREENING_FAILED)
#: Older spellings.
LEGACY = {"included": INCLUDED_ABSTRACT, "excluded": EXCLUDED_ABSTRACT, "fulltext_retrieved": INCLUDED_ABSTRACT}


def normalised(x: Column) -> Column:
    """State by value or name in any case, older spellings too; null if unknown."""
    t = F.lower(strip(x))
    out = F.when(t.isin(*STATES), t)
    for old, new in LEGACY.items():
        out = out.when(t == old, new)
    return out


def with_threshold(decision: Column, confidence: Column, incomplete: Column, stage: str, reporting: bool, threshold: float | None) -> Column:
    """Decision after the confidence rule. An incomplete full text wins over it."""
    active = reporting and threshold is not None and 0.0 <= threshold <= 1.0
    out = F.when(decision.isNotNull() & (confidence < threshold), "EXCLUDED").otherwise(decision) if active else decision
    if stage == "fulltext":
        out = F.when(F.coalesce(incomplete, F.lit(False)), "FULLTEXT_INCOMPLETE").otherwise(out)
    return out


def below_threshold(confidence: Column, reporting: bool, threshold: float | None) -> Column:
    active = reporting and threshold is not None and 0.0 <= threshold <= 1.0
    return F.coalesce(confidence < threshold, F.lit(False)) if active else F.lit(False)


def threshold_reason(reason: Column, confidence: Column, threshold: float) -> Column:
    """Reason of a decision that the threshold has turned. Numbers are printed as
    Python prints them, which no built-in does: binary value to two digits."""

    @F.pandas_udf(T.StringType())
    def text(r, c):
        return r.combine(c, lambda a, b: f"Confidence {b:.2f} below threshold {threshold}. {a}")

    return text(F.coalesce(reason, F.lit("")), confidence)


def decided(stage: str, decision: Column) -> Column:
    """State that a decision of a stage leads to: anything that doesn't include excludes."""
    if stage == "abstract":
        return F.when(decision == "INCLUDED", INCLUDED_ABSTRACT).when(decision == "SCREENING_FAILED", SCREENING_FAILED).otherwise(EXCLUDED_ABSTRACT)
    out = F.when(decision == "INCLUDED", INCLUDED_FULLTEXT).when(decision == "FULLTEXT_INCOMPLETE", FULLTEXT_INCOMPLETE)
    return out.when(decision == "SCREENING_FAILED", SCREENING_FAILED).otherwise(EXCLUDED_FULLTEXT)


def promoted(status: Column, stage: str) -> Column:
    """State after a stage that is skipped."""
    before, after = (PENDING, INCLUDED_ABSTRACT) if stage == "abstract" else (INCLUDED_ABSTRACT, INCLUDED_FULLTEXT)
    return F.when(status == before, after).otherwise(status)


def cached_state(decision: Column, stage: str) -> Column:
    """State of a stored decision, old spellings included; null sends the study
    to be screened again."""
    t = F.lower(strip(decision))
    yes = t.isin("included", INCLUDED_ABSTRACT, INCLUDED_FULLTEXT)
    no = t.isin("excluded", EXCLUDED_ABSTRACT, EXCLUDED_FULLTEXT)
    keep, drop = (INCLUDED_ABSTRACT, EXCLUDED_ABSTRACT) if stage == "abstract" else (INCLUDED_FULLTEXT, EXCLUDED_FULLTEXT)
    return F.when(yes, keep).when(no, drop).otherwise(normalised(decision))

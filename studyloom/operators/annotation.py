"""Annotation of analyses: scopes, ids, completeness, model payloads, upserts, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions import status as st
from studyloom.functions.text import boolean, is_criteria_id, not_nan, prefer, strip
from studyloom.operators.relational import last_by

#: System annotations and the studies that each takes in.
SCOPES = ("all_studies", "all_abstract", "all_analyses")
KEY = ["study_id", "analysis_id", "annotation_name"]


def in_scope(studies: DataFrame, scope: str) -> DataFrame:
    """Studies of a scope. all_abstract leaves out what abstract screening has
    excluded, so pending and failed studies count."""
    if scope == "all_studies":
        return studies
    s = F.col("status")
    return studies.where(s != st.EXCLUDED_ABSTRACT) if scope == "all_abstract" else studies.where(s == st.INCLUDED_FULLTEXT)


def number_analyses(analyses: DataFrame, key: str = "pmid", order: str = "pos") -> DataFrame:
    """``analysis_id`` from the place of an analysis in its study's list, from 0."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return analyses.withColumn("analysis_id", F.concat(F.col(key).cast("string"), F.lit("_analysis_"), place.cast("string")))


def explode_analyses(studies: DataFrame) -> DataFrame:
    """(pmid, status, title, analysis_id, analysis...) of nested studies."""
    rows = studies.select("pmid", "status", "title", F.posexplode("analyses").alias("pos", "analysis"))
    return rows.withColumn("analysis_id", F.concat("pmid", F.lit("_analysis_"), F.col("pos").cast("string")))


def system_decisions(analyses: DataFrame) -> DataFrame:
    """Decisions of the three system annotations over analyses with a status."""
    parts = []
    for scope in SCOPES:
        rows = in_scope(analyses, scope).select(F.col("pmid").cast("string").alias("study_id"), "analysis_id")
        parts.append(rows.select("study_id", "analysis_id", F.lit(scope).alias("annotation_name"), F.lit(True).alias("include"), F.lit("none").alias("model_used")))
    return parts[0].union(parts[1]).union(parts[2])


def complete(decisions: DataFrame, analyses: DataFrame) -> DataFrame:
    """(study_id, annotation_name, n, need, complete): as many decisions as analyses,
    no more; a study without analyses is never complete."""
    got = decisions.groupBy("study_id", "annotation_name").agg(F.count("*").alias("n"))
    need = analyses.groupBy("study_id").agg(F.count("*").alias("need"))
    return got.join(need, "study_id", "left").select("study_id", "annotation_name", "n", F.coalesce("need", F.lit(0)).alias("need"), F.coalesce(F.col("n") == F.col("need"), F.lit(False)).alias("complete"))


def upsert(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Decisions after a run. For each study the updated names go, and, if a custom
    annotation was updated, all its custom ones; of equal keys the last by ``pos``
    stays. ``strict`` replaces equal keys only."""
    if strict:
        rest = old.join(new.select(*KEY).distinct(), KEY, "left_anti")
    else:
        custom = ~F.col("annotation_name").isin(*SCOPES)
        updated = new.groupBy("study_id").agg(F.collect_set("annotation_name").alias("_names"), F.bool_or(custom).alias("_custom"))
        joined = old.join(updated, "study_id", "left")
        goes = F.array_contains("_names", F.col("annotation_name")) | (F.col("_custom") & custom)
        rest = joined.where(F.col("_names").isNull() | ~goes).drop("_names", "_custom")
    return last_by(rest.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True).withColumn("_order", F.struct("_new", "pos")), KEY, "_order").drop("_new", "_order")


def notes(decisions: DataFrame, analyses: DataFrame, names: list[str]) -> DataFrame:
    """One row per exported analysis and a boolean column for each name: the last
    decision by ``pos``, false where there is none."""
    last = decisions.groupBy("analysis_id", "annotation_name").agg(F.max_by("include", "pos").alias("include"))
    wide = last.groupBy("analysis_id").pivot("annotation_name", names).agg(F.max("include"))
    joined = analyses.select("analysis_id").distinct().join(wide, "analysis_id", "left")
    return joined.select("analysis_id", *[F.coalesce(F.col(f"`{n}`"), F.lit(False)).alias(n) for n in names])


def boolean_columns(note_keys: dict[str, str], wanted: list[str] | None = None) -> list[str]:
    """Columns of kind boolean, in the asked order; others are left out."""
    ready = [k for k, kind in note_keys.items() if kind == "boolean"]
    return [k for k in wanted if k in ready] if wanted is not None else ready


PAYLOAD = (
    "decisions array<struct<analysis_id:string,annotations:array<struct<annotation_name:string,include:string,reasoning:string,"
    "inclusion_criteria_applied:array<string>,exclusion_criteria_applied:array<string>>>>>"
)


def parse_payload(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """Decisions of model payloads: study -> analyses -> annotations, flat. ``error``
    says what a payload lacks; such a payload is one row without a decision."""
    parsed = responses.withColumn("_p", F.from_json(payload, PAYLOAD))
    rows = parsed.select("study_id", "attempt", F.posexplode_outer("_p.decisions").alias("i", "d")).select("study_id", "attempt", "i", F.col("d.analysis_id").alias("analysis_id"), F.posexplode_outer("d.annotations").alias("j", "a"))
    pos = F.coalesce(F.col("i").cast("long") * 100_000 + F.col("j"), F.lit(0))
    out = rows.select("study_id", "attempt", pos.alias("pos"), strip(F.col("analysis_id")).alias("analysis_id"), "a.annotation_name", boolean(F.col("a.include")).alias("include"), "a.reasoning", "a.inclusion_criteria_applied", "a.exclusion_criteria_applied")
    error = F.when(F.col("analysis_id").isNull(), "no analysis_id").when(F.col("annotation_name").isNull(), "no annotation").when(F.col("include").isNull(), "no include")
    return out.withColumn("error", error)


SINGLE = (
    "decisions array<struct<annotation_name:string,include:string,reasoning:string,inclusion_criteria_applied:array<string>,exclusion_criteria_applied:array<string>>>"
)


def single_payloads(responses: DataFrame, names: list[str], payload: str = "payload") -> DataFrame:
    """Answers about one analysis each (``item_id``) in the form of answers about a
    study. A bare decision without a list is taken if one annotation was asked for;
    what has neither form stays as it is, for ``parse_payload`` to refuse."""
    p = F.from_json(payload, f"{SINGLE}, include string, reasoning string, inclusion_criteria_applied array<string>, exclusion_criteria_applied array<string>")
    listed = p["decisions"]
    if len(names) == 1:
        bare = F.struct(F.lit(names[0]).alias("annotation_name"), *[p[c].alias(c) for c in ("include", "reasoning", "inclusion_criteria_applied", "exclusion_criteria_applied")])
        listed = F.coalesce(listed, F.when(p["include"].isNotNull(), F.array(bare)))
    whole = F.struct(F.array(F.struct(F.col("item_id").alias("analysis_id"), listed.alias("annotations"))).alias("decisions"))
    return responses.withColumn(payload, F.when(listed.isNotNull(), F.to_json(whole)).otherwise(F.col(payload)))


def bad_payloads(responses: DataFrame, analyses: DataFrame, names: list[str], mapping: DataFrame | None = None) -> DataFrame:
    """(study_id) of payloads that are broken, speak of analyses the study does not
    have, leave an analysis or an annotation out, give one twice, or cite criteria
    that are not theirs. ``analyses`` has (study_id, analysis_id)."""
    rows = parse_payload(responses)
    broken = rows.where("error is not null").select("study_id")
    sound = rows.where("error is null")
    other = hallucinated(sound, analyses).select("study_id")
    cover = coverage(sound, names).where("size(missing) > 0 or size(extra) > 0 or duplicates").select("study_id")
    asked = analyses.join(responses.select("study_id").distinct(), "study_id", "left_semi").select("study_id", "analysis_id").distinct()
    absent = asked.join(sound.select("study_id", "analysis_id").distinct(), ["study_id", "analysis_id"], "left_anti").select("study_id")
    cited = criteria_errors(sound, mapping).where("criteria_error is not null").select("study_id")
    return broken.union(other).union(cover).union(absent).union(cited).distinct()


def unfinished(studies: DataFrame, decisions: DataFrame | None, names: list[str]) -> DataFrame:
    """Of ``studies`` (pmid, analyses) those that lack stored decisions for some
    analysis and name."""
    if decisions is None:
        return studies
    asked = explode_analyses(studies).select(F.col("pmid").alias("study_id"), "analysis_id")
    need = asked.select("study_id", "analysis_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("annotation_name"))
    open_ = need.join(decisions.select(*KEY).distinct(), KEY, "left_anti").select(F.col("study_id").alias("pmid")).distinct()
    return studies.join(open_, "pmid", "left_semi")


def first_valid(responses: DataFrame, tries: int = 3) -> DataFrame:
    """The first attempt of each study, up to ``tries``, that is valid."""
    return responses.where(F.col("valid") & (F.col("attempt") <= tries)).groupBy("study_id").agg(F.min_by("payload", "attempt").alias("payload"), F.min("attempt").alias("attempt"))


def hallucinated(decisions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Decisions about analyses that their study does not have."""
    known = analyses.select("study_id", "analysis_id").distinct()
    return decisions.withColumn("analysis_id", strip(F.col("analysis_id"))).join(known, ["study_id", "analysis_id"], "left_anti")


def coverage(decisions: DataFrame, names: list[str]) -> DataFrame:
    """(study_id, analysis_id, missing, extra, duplicates) of each analysis."""
    got = decisions.groupBy("study_id", "analysis_id").agg(F.collect_list("annotation_name").alias("l"))
    wanted = F.array(*[F.lit(n) for n in names])
    return got.select("study_id", "analysis_id", F.array_sort(F.array_except(wanted, "l")).alias("missing"), F.array_sort(F.array_except("l", wanted)).alias("extra"), (F.size("l") != F.size(F.array_distinct("l"))).alias("duplicates"))


def criteria_errors(decisions: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Decisions with ``criteria_error``. With a mapping (annotation_name, inclusion,
    exclusion: arrays of ids) ids must be listed, an inclusion must cite one, and an
    exclusion without one must name an inclusion id in its reasoning; else ids must
    look like ids."""
    inc, exc = F.coalesce("inclusion_criteria_applied", F.array().cast("array<string>")), F.coalesce("exclusion_criteria_applied", F.array().cast("array<string>"))
    if mapping is None:
        bad = ~F.forall(F.concat(inc, exc), is_criteria_id)
        return decisions.withColumn("criteria_error", F.when(bad, "not an id"))
    joined = decisions.join(mapping.select("annotation_name", F.col("inclusion").alias("_i"), F.col("exclusion").alias("_e")), "annotation_name", "left")
    cited = F.exists("_i", lambda i: F.contains(F.coalesce("reasoning", F.lit("")), i))
    error = (
        F.when(F.col("_i").isNull(), F.when(~F.forall(F.concat(inc, exc), is_criteria_id), "not an id"))
        .when(~F.forall(inc, lambda x: F.array_contains("_i", x)) | ~F.forall(exc, lambda x: F.array_contains("_e", x)), "unknown id")
        .when(F.col("include") & (F.size(inc) == 0) & (F.size("_i") > 0), "inclusion without an id")
        .when(~F.col("include") & (F.size(exc) == 0) & (F.size("_i") > 0) & ~cited, "exclusion without a reason")
    )
    return joined.withColumn("criteria_error", error).drop("_i", "_e")


def quarantine(studies: DataFrame) -> DataFrame:
    """(study_id, analysis_id, table_id, reason) of the analyses whose table their study
    does not have. An analysis that names no table is not among them."""
    rows = studies.select("pmid", F.transform(F.coalesce("activation_tables", F.array().cast(studies.schema["activation_tables"].dataType)), lambda t: t["table_id"]).alias("tables"), F.posexplode("analyses").alias("pos", "a"))
    reason = F.when(F.size("tables") == 0, "no tables").when(~F.coalesce(F.array_contains("tables", F.col("a.table_id")), F.lit(False)), "unknown table")
    found = rows.where(F.col("a.table_id").isNotNull()).select(F.col("pmid").alias("study_id"), F.concat("pmid", F.lit("_analysis_"), F.col("pos").cast("string")).alias("analysis_id"), F.col("a.table_id").alias("table_id"), reason.alias("reason"))
    return found.where("reason is not null")


def with_table(analyses: DataFrame, tables: DataFrame) -> DataFrame:
    """Analyses with caption and foot of their table; ``table_error`` where a table id
    is given but the study has no such table."""
    known = tables.select("pmid", "table_id", not_nan(F.col("table_caption")).alias("table_caption"), not_nan(F.col("table_foot")).alias("table_foot"), F.lit(True).alias("_known"))
    joined = analyses.join(known, ["pmid", "table_id"], "left")
    error = F.when(F.col("table_id").isNotNull() & F.col("_known").isNull(), "unknown table")
    out = joined.withColumn("table_error", error).withColumn("table_id", F.coalesce("table_id", F.concat("pmid", F.lit("_default_table"))))
    return out.withColumn("table_caption", prefer(F.col("table_caption"), "Unnamed Table")).drop("_known")

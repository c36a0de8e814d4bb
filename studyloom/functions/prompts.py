"""Prompts as column expressions: what the model is told about a study, a table or
its analyses."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.text import field_label, filled, joined, prefer

# What a configuration may name as metadata of an analysis.
METADATA = ("analysis_name", "analysis_description", "table_caption", "table_footer", "study_title", "study_abstract", "study_authors", "study_journal", "study_publication_date", "study_fulltext")


def _criteria(stage: dict[str, Any]) -> str:
    mapping = stage.get("criteria_mapping") or {}
    out = []
    for kind in ("inclusion", "exclusion"):
        ids = mapping.get(kind) or {}
        items = [f"{k}: {v}" for k, v in ids.items()] or list(stage.get(f"{kind}_criteria") or [])
        if items:
            out.append(f"{kind.capitalize()} criteria:\n" + "\n".join(f"- {x}" for x in items))
    return "\n\n".join(out)


def screening(stage: dict[str, Any], kind: str, title: Column, abstract: Column, authors: Column | None = None, journal: Column | None = None, body: Column | None = None) -> Column:
    """Prompt of an abstract or full-text screening; null without a full text where
    one is needed, which screening takes as a failure."""
    head = [f"Objective: {stage.get('objective') or ''}", _criteria(stage)]
    if stage.get("additional_instructions"):
        head.append(f"Further instructions: {stage['additional_instructions']}")
    ask = "Answer with a JSON object: decision (INCLUDED or EXCLUDED), reason, confidence (between 0 and 1), inclusion_criteria_applied and exclusion_criteria_applied (lists of the ids that apply)"
    ask += ", fulltext_incomplete (true or false)." if kind == "fulltext" else "."
    parts = [F.lit("\n\n".join(x for x in head if x)), F.concat(F.lit("Title: "), prefer(title, "Untitled"))]
    if authors is not None:
        parts.append(F.concat(F.lit("Authors: "), F.coalesce(joined(authors), F.lit("Not available"))))
    if journal is not None:
        parts.append(F.concat(F.lit("Journal: "), prefer(journal, "Not available")))
    parts.append(F.concat(F.lit("Abstract: "), prefer(abstract, "No abstract available")))
    if kind == "fulltext":
        parts.append(F.concat(F.lit("Full text:\n"), body))
    # concat, not concat_ws: a missing full text makes the prompt null
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("\n\n"), p)
    return F.concat(out, F.lit("\n\n" + ask))


def table(caption: Column, foot: Column, raw: Column) -> Column:
    """Prompt that asks for the analyses and points of a table."""
    ask = "List every analysis of this table with its points: three coordinates, the space (MNI, TAL or null) and values with their kind. Answer with a JSON object: analyses, a list of objects with name, description and points (coordinates, space, values)."
    return F.concat(F.lit(ask + "\n\nCaption: "), prefer(caption, "none"), F.lit("\nFooter: "), prefer(foot, "none"), F.lit("\n\n"), raw)


def annotation(study: Column, fields: list[str], rules: list[dict[str, Any]]) -> Column:
    """Prompt about all analyses of a study (title, abstract, fulltext, analyses:
    id, name, description, table_id, table_caption, table_foot), table by table."""
    about = [F.concat(F.lit("Title: "), prefer(study["title"], "Untitled"))]
    if "study_abstract" in fields:
        about.append(F.concat(F.lit("Abstract: "), prefer(study["abstract"], "No abstract available")))
    if "study_fulltext" in fields:
        about.append(F.concat(F.lit("Full text:\n"), prefer(study["fulltext"], "Not available")))
    keep = {"analysis_name": "name", "analysis_description": "description"}
    item = lambda a: F.concat_ws(" | ", F.concat(F.lit("- "), a["id"]), *[a[v] for k, v in keep.items() if k in fields])
    about.append(F.concat(F.lit("Analyses:\n"), F.array_join(F.transform(by_table(study["analyses"]), lambda t: _section(t, item)), "\n")))
    ask = (
        "Decide on every annotation for every analysis. Answer with a JSON object: decisions, a list of objects with analysis_id and annotations, a list of objects "
        "with annotation_name, include (true or false), reasoning, inclusion_criteria_applied and exclusion_criteria_applied (lists of the ids that apply)."
    )
    return F.concat_ws("\n\n", F.lit(_rules(rules)), *about, F.lit(ask))


def _rules(rules: list[dict[str, Any]]) -> str:
    lines = [x for r in rules for x in (f"Annotation {r['name']}: {r.get('description') or ''}", _criteria(r))]
    return "\n".join(x for x in lines if x)


def by_table(analyses: Column) -> Column:
    """Analyses under their tables (caption, foot, analyses), tables in the order of
    their first analysis."""
    ids = F.array_distinct(F.transform(analyses, lambda a: F.struct(a["table_id"].alias("id"))))
    own = F.transform(ids, lambda t: F.filter(analyses, lambda a: a["table_id"].eqNullSafe(t["id"])))
    return F.transform(own, lambda l: F.struct(l[0]["table_caption"].alias("caption"), l[0]["table_foot"].alias("foot"), l.alias("analyses")))


def _section(t: Column, item) -> Column:
    foot = F.when(filled(t["foot"]), F.concat(F.lit("Footer: "), t["foot"]))
    return F.concat_ws("\n", F.concat(F.lit("Table: "), prefer(t["caption"], "Unnamed Table")), foot, F.array_join(F.transform(t["analyses"], item), "\n"))


def single_analysis(about: Column, fields: list[str], rules: list[dict[str, Any]], custom: dict[str, Column] | None = None) -> Column:
    """Prompt about one analysis. ``about`` has the fields of ``METADATA``, ``custom``
    further ones by name; those that ``fields`` names and that are filled are told."""
    told = {f: (F.lit(f.replace("_", " ").capitalize()), about[f]) for f in METADATA} | {k: (field_label(F.lit(k)), v) for k, v in (custom or {}).items()}
    lines = [F.when(filled(v), F.concat(F.lit("- "), label, F.lit(": "), v)) for k, (label, v) in told.items() if k in fields]
    ask = (
        "Decide on every annotation for this one analysis; what the table or the study says of other analyses does not count. Answer with a JSON object: decisions, a list of objects "
        "with annotation_name, include (true or false), reasoning, inclusion_criteria_applied and exclusion_criteria_applied (lists of the ids that apply)."
    )
    return F.concat_ws("\n\n", F.lit(_rules(rules)), prefer(F.concat_ws("\n", *lines), "Nothing is known about the analysis."), F.lit(ask))

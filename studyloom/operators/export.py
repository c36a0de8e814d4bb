"""The nested study set and its annotation, as one-row documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions import status as st
from studyloom.functions.coords import rounded_point, space
from studyloom.functions.text import analysis_name, joined, publication_year


def exportable(studies: DataFrame, export_excluded: bool = False) -> DataFrame:
    """Studies with analyses; only included ones unless told otherwise."""
    some = studies.where(F.coalesce(F.size("analyses") > 0, F.lit(False)))
    return some if export_excluded else some.where(F.col("status") == st.INCLUDED_FULLTEXT)


def _point(p: Column, i: Column, analysis_id: Column, study_space: Column) -> Column:
    values = F.transform(F.coalesce(p["values"], F.array().cast("array<struct<value_text:string,value_num:double,kind:string>>")), lambda v: F.struct(v["kind"].alias("kind"), v["value_text"].alias("value")))
    return F.struct(
        F.concat(analysis_id, F.lit("_point_"), i.cast("string")).alias("id"), rounded_point(p["coordinates"]).alias("coordinates"), space(p["space"], study_space).alias("space"),
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("label_id"), values.alias("values"), analysis_id.alias("analysis_id"),
    )


def _analysis(a: Column, i: Column, study_id: Column, study_space: Column) -> Column:
    own = analysis_name(F.concat(study_id, F.lit("_analysis_"), i.cast("string")))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return F.struct(
        own.alias("id"), analysis_name(a["name"]).alias("name"), a["description"].alias("description"), none("double").alias("weights"), none("string").alias("conditions"),
        none("string").alias("images"), F.transform(F.coalesce(a["points"], none("struct<coordinates:array<double>,space:string,values:array<struct<value_text:string,value_num:double,kind:string>>>")), lambda p, k: _point(p, k, own, study_space)).alias("points"),
        study_id.alias("study_id"),
    )


def nimads_studies(studies: DataFrame) -> DataFrame:
    """(pos, study): one struct per study, everything nested inside the row."""
    sid = F.coalesce("pmid", F.concat(F.lit("study_"), F.col("pos").cast("string")))
    study = F.struct(
        sid.alias("id"), F.col("doi"), F.col("title").alias("name"), F.lit(None).cast("map<string,string>").alias("metadata"), F.col("abstract").alias("description"),
        F.col("journal").alias("publication"), F.col("pmid"), joined(F.col("authors")).alias("authors"), publication_year(F.col("publication_date")).alias("year"),
        F.transform("analyses", lambda a, i: _analysis(a, i, sid, F.col("coordinate_space"))).alias("analyses"),
    )
    return studies.select("pos", study.alias("study"))


def _by_pos(a: Column, b: Column) -> Column:
    """Studies hold maps, which have no order of their own."""
    return F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)


def nimads_studyset(studies: DataFrame, set_id: str, name: str = "studyset") -> DataFrame:
    """The document as one row, for a set that fits one; a review writes its document
    from ``nimads_studies`` as a stream."""
    rows = nimads_studies(studies).agg(F.array_sort(F.collect_list(F.struct("pos", "study")), _by_pos).alias("s"))
    none = F.lit(None).cast("string")
    return rows.select(F.lit(set_id).alias("id"), F.lit(name).alias("name"), none.alias("description"), none.alias("publication"), none.alias("doi"), none.alias("pmid"), F.transform("s", lambda x: x["study"]).alias("studies"))


def studyset_facts(set_id: str, name: str = "studyset") -> dict:
    """What the study set's document says beside its studies."""
    return {"id": set_id, "name": name, "description": None, "publication": None, "doi": None, "pmid": None}


def annotation_facts(names: list[str], annotation_id: str, set_id: str, name: str) -> dict:
    """What the annotation's document says beside its notes."""
    return {"id": annotation_id, "name": name, "description": None, "metadata": None, "note_keys": {n: "boolean" for n in names}, "studyset": set_id}


def note_rows(notes: DataFrame, names: list[str], annotation_id: str) -> DataFrame:
    """(analysis, note, annotation) of wide notes (analysis_id and a column for each
    name). Ids are cleaned as those of the study set are."""
    note = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`"))])
    return notes.select(analysis_name(F.col("analysis_id")).alias("analysis"), note.alias("note"), F.lit(annotation_id).alias("annotation"))


def nimads_annotation(notes: DataFrame, names: list[str], annotation_id: str, set_id: str, name: str) -> DataFrame:
    """The annotation document of wide notes as one row, for notes that fit one; a review
    writes its document from ``note_rows`` as a stream."""
    row = F.to_json(F.struct("analysis", "note", "annotation"))
    rows = note_rows(notes, names, annotation_id).agg(F.array_sort(F.collect_list(F.struct(F.col("analysis").alias("k"), row.alias("v")))).alias("n"))
    schema = "struct<analysis:string,note:map<string,boolean>,annotation:string>"
    keys = F.create_map(*[x for n in names for x in (F.lit(n), F.lit("boolean"))])
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(annotation_id).alias("id"), F.lit(name).alias("name"), none.alias("description"), F.lit(None).cast("map<string,string>").alias("metadata"), keys.alias("note_keys"),
        F.lit(set_id).alias("studyset"), F.transform("n", lambda x: F.from_json(x["v"], schema)).alias("notes"),
    )


def default_notes(studies: DataFrame) -> DataFrame:
    """Notes of the default annotation: every exported analysis is in."""
    rows = nimads_studies(studies).select(F.explode("study.analyses").alias("a"))
    return rows.select(F.col("a.id").alias("analysis_id"), F.lit(True).alias("all_analyses"))

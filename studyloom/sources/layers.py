"""JSON files of an earlier or another tool's run as the lowest layer of a run's tables.

A record that can't be read is set apart with its place and a reason; the others
of its file count. The run's own tables lie above: of equal keys theirs is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom import schemas
from studyloom.functions import status as st
from studyloom.operators.relational import last_by
from studyloom.sources import files

BROKEN = "file string, pos int, reason string, record string"
_SEARCH = T.StructType([f for f in schemas.STUDY.fields if f.name in ("pmid", "title", "abstract", "authors", "journal", "publication_date", "doi", "keywords", "status", "pmcid")])
_PARSED = T.StructType([schemas.STUDY["pmid"], schemas.STUDY["analyses"]])
#: Name of a layer: its file, the list's key in it (none: the file is the list), the
#: schema of a record, what a record must have, and its key.
LAYERS = {
    "search": ("search_results.json", "studies", _SEARCH, ("pmid",), ["pmid"]),
    "abstract_screening": ("abstract_screening_results.json", "screening_results", schemas.SCREENING, ("study_id", "decision"), ["study_id"]),
    "fulltext_screening": ("fulltext_screening_results.json", "screening_results", schemas.SCREENING, ("study_id", "decision"), ["study_id"]),
    "coordinates": ("coordinate_parsing_results.json", "studies", _PARSED, ("pmid", "analyses"), ["pmid"]),
    "annotations": ("annotation_results.json", None, schemas.DECISION, ("analysis_id", "annotation_name", "include"), ["study_id", "analysis_id", "annotation_name"]),
}


def records(spark: SparkSession, path: str, name: str | None, schema: T.StructType, needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``pos``, broken) of a file of records. A file that is no JSON of that
    form is one broken record; one that is not there has neither."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("pos", T.IntegerType()), *schema.fields])), spark.createDataFrame([], BROKEN)
    listed = "array<string>" if name is None else f"struct<`{name}`:array<string>>"
    got = F.from_json("value", listed)
    texts = spark.read.text(path, wholetext=True).select("value", (got if name is None else got[name]).alias("list"))
    each = texts.select(F.posexplode("list").alias("pos", "record"))
    # a record is kept as text beside its fields, which are null where they don't fit
    read = each.select("pos", "record", F.from_json("record", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in needed]))
    reason = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not of this form").when(F.size(lacking) > 0, F.concat(F.lit("no "), F.array_join(lacking, ", ")))
    judged = read.select("pos", "record", "r", reason.alias("reason"))
    rows = judged.where("reason is null").select("pos", *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    whole = texts.where("list is null").select(F.lit(path).alias("file"), F.lit(-1).alias("pos"), F.lit("no list of records").alias("reason"), F.col("value").alias("record"))
    return rows, judged.where("reason is not null").select(F.lit(path).alias("file"), "pos", "reason", "record").union(whole)


def layer(spark: SparkSession, folder: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken) of a layer's file in ``folder``: the last record of each key."""
    file, name, schema, needed, key = LAYERS[kind]
    rows, broken = records(spark, f"{folder.rstrip('/')}/{file}", name, schema, needed)
    rows = last_by(rows, key, "pos")
    if kind == "search":
        rows = rows.withColumn("status", F.coalesce(st.normalised(F.col("status")), F.lit(st.PENDING))).withColumn("pos", F.col("pos").cast("long"))
    elif kind == "coordinates":
        rows = rows.withColumn("analyses", F.transform("analyses", _as_parsed))
    elif kind.endswith("screening"):
        rows = rows.withColumn("screening_type", F.coalesce("screening_type", F.lit(kind.removesuffix("_screening")))).drop("pos")
    else:
        rows = rows.withColumn("pos", F.col("pos").cast("long"))
    return rows, broken


def _as_parsed(a: Column) -> Column:
    return a.withField("parsed", F.coalesce(a["parsed"], F.lit(True)))


def above(upper: DataFrame | None, lower: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``upper``, and those of ``lower`` whose key it lacks. Null keys are equal."""
    if upper is None:
        return lower
    have = upper.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return upper.unionByName(lower.join(have, same, "left_anti"), allowMissingColumns=True)

"""Full-text retrieval: scope, sources, tables, coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions import status as st
from studyloom.functions.coords import SPACES
from studyloom.operators.relational import flag


def in_scope(studies: DataFrame, load_excluded: bool = False) -> DataFrame:
    """All studies with retrieval_in_scope, and in_included_set for those in scope."""
    states = [st.INCLUDED_ABSTRACT, st.EXCLUDED_ABSTRACT] if load_excluded else [st.INCLUDED_ABSTRACT]
    scope = F.col("status").isin(*states)
    return studies.withColumn("retrieval_in_scope", scope).withColumn("in_included_set", F.when(scope, F.col("status") == st.INCLUDED_ABSTRACT))


def capped(ids: DataFrame, n_docs: int | None = None, key: str = "pmcid") -> DataFrame:
    """The first ``n_docs`` ids in their order, or all: how much a download may take."""
    return ids if n_docs is None else ids.orderBy(key).limit(n_docs)


def number_pmids(studies: DataFrame) -> DataFrame:
    """(pmid, pmid_number) of studies whose pmid is digits alone."""
    return studies.where(F.col("pmid").rlike("^[0-9]+$")).select("pmid", F.col("pmid").try_cast("bigint").alias("pmid_number"))


def mark_retrieved(studies: DataFrame, retrieved: DataFrame, source: str = "pubget") -> DataFrame:
    """Availability and source of the studies whose pmcid was retrieved."""
    marked = flag(studies, retrieved, "pmcid", "_got")
    has = F.col("_got")
    return (
        marked.withColumn("fulltext_available", has | F.coalesce("fulltext_available", F.lit(False)))
        .withColumn("full_text_source", F.when(has, F.coalesce("full_text_source", F.lit(source))).otherwise(F.col("full_text_source")))
        .drop("_got")
    )


def tables_with_coordinates(tables: DataFrame, coordinates: DataFrame, key: str) -> DataFrame:
    return tables.join(coordinates.select(key, "table_id").distinct(), [key, "table_id"], "left_semi")


def group_coordinates(coordinates: DataFrame, key: str, pos: str = "row_pos") -> DataFrame:
    """One analysis for each (id, table_id) with its points in file order; null
    keys are dropped. ``analysis_pos`` counts an id's tables in order."""
    rows = coordinates.where(F.col(key).isNotNull() & F.col("table_id").isNotNull())
    point = F.struct(F.col(pos).alias("pos"), F.array("x", "y", "z").alias("coordinates"))
    grouped = rows.groupBy(key, "table_id").agg(F.min_by("table_label", pos).alias("description"), F.array_sort(F.collect_list(point)).alias("p"))
    made = F.transform("p", lambda p: F.struct(p["coordinates"].alias("coordinates"), F.lit(None).cast("string").alias("space")))
    order = Window.partitionBy(key).orderBy("table_id")
    return grouped.select(key, (F.row_number().over(order) - 1).alias("analysis_pos"), "table_id", F.col("table_id").alias("name"), "description", F.lit(False).alias("parsed"), made.alias("points"))


def attach(studies: DataFrame, rows: DataFrame, key: str, column: str, pos: str, replace: bool) -> DataFrame:
    """Rows as a list in order of ``pos`` under their study: in place of what is
    there, or behind it. Studies without rows stay as they are."""
    fields = [c for c in rows.columns if c not in (key, pos)]
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_pos"), F.struct(*fields).alias("_row")))).alias("_rows"))
    lists = lists.select(key, F.transform("_rows", lambda r: r["_row"]).alias("_new"))
    joined = studies.join(lists, key, "left")
    if column not in studies.columns:
        return joined.withColumn(column, F.col("_new")).drop("_new")
    both = F.col("_new") if replace else F.concat(F.coalesce(F.col(column), F.array().cast(studies.schema[column].dataType)), F.col("_new"))
    return joined.withColumn(column, F.coalesce(F.when(F.col("_new").isNotNull(), both), F.col(column))).drop("_new")


def merge_csv(existing: DataFrame, new: DataFrame, key: str = "pmcid") -> DataFrame:
    """New rows in place of all rows with their key; without the key they are appended."""
    if key not in existing.columns or key not in new.columns:
        return existing.unionByName(new, allowMissingColumns=True)
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def known_space(spaces: DataFrame) -> DataFrame:
    """(pmcid, coordinate_space) of known spaces."""
    return spaces.where(F.col("coordinate_space").isin(*SPACES)).select("pmcid", "coordinate_space").dropDuplicates(["pmcid"])


def report(studies: DataFrame) -> DataFrame:
    """Rows of the retrieval report: studies with a text or a pmcid."""
    with_points = F.coalesce(F.exists("analyses", lambda a: F.exists(a["points"], lambda p: F.size(p["coordinates"]) == 3)), F.lit(False))
    cols = ["pmid", "pmcid", "title", "retrieved_at", "status", "full_text_path", "fulltext_available"]
    return studies.where(F.coalesce("fulltext_available", F.lit(False)) | F.col("pmcid").isNotNull()).select(*cols, with_points.alias("coordinates_found"))


def retrieval_stats(studies: DataFrame) -> DataFrame:
    """One row: considered, available (of all studies), missing (of those in scope)."""
    scope, has = F.coalesce("retrieval_in_scope", F.lit(False)), F.coalesce("fulltext_available", F.lit(False))
    return studies.agg(F.count_if(scope).alias("considered"), F.count_if(has).alias("available"), F.count_if(scope & ~has).alias("missing"))

"""Extension points: a search engine, a screening engine, a full-text retriever.

Each is a function of DataFrames behind a small class; the pipeline takes any
object with the same methods.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom import schemas
from studyloom.config import PipelineConfig, SearchConfig
from studyloom.operators import models, relational, retrieval, screening
from studyloom.sources import csv_sets, files, pubmed


class SearchEngine(ABC):
    @abstractmethod
    def search(self, spark: SparkSession, config: SearchConfig) -> DataFrame:
        """Studies of a query."""

    def info(self, config: SearchConfig) -> dict:
        return {"engine": type(self).__name__, "database": config.database, "query": config.query, "max_results": config.max_results}


class PubMedSearch(SearchEngine):
    """The remote search service; ``workers`` partitions fetch at once."""

    def __init__(self, fetch=pubmed.get, workers: int = 1, pause: float = 0.5):
        self.fetch, self.workers, self.pause = fetch, workers, pause

    def ids(self, spark: SparkSession, config: SearchConfig) -> DataFrame:
        """Ids of the query, then those of the list or file; nothing is dropped."""
        parts = []
        if config.query.strip():
            parts.append(pubmed.search_ids(spark, pubmed.build_query(config.query, config.date_from, config.date_to), config.max_results, config.email, self.fetch).select("pmid"))
        if config.pmids_list or config.pmids_file:
            parts.append(pubmed.read_ids(spark, config.pmids_list, config.pmids_file).select("pmid"))
        return relational.union_ids(parts)

    def details(self, ids: DataFrame) -> DataFrame:
        return pubmed.studies(pubmed.articles(pubmed.fetch_xml(ids.repartition(self.workers), self.fetch, self.pause)))

    def search(self, spark: SparkSession, config: SearchConfig) -> DataFrame:
        return self.details(self.ids(spark, config))

    def pmcids(self, ids: DataFrame) -> DataFrame:
        """(pmid, pmcid) of the ids that the converter knows."""
        return pubmed.convert_ids(ids.repartition(self.workers), self.fetch, self.pause)


class StoredSearch(SearchEngine):
    """Studies of a Parquet table in place of a service."""

    def __init__(self, path: str):
        self.path = path

    def search(self, spark: SparkSession, config: SearchConfig) -> DataFrame:
        return spark.read.parquet(self.path)


class ScreeningEngine(ABC):
    @abstractmethod
    def screen(self, studies: DataFrame, stage: str) -> DataFrame:
        """Screening results of studies with a prompt."""


class ModelScreening(ScreeningEngine):
    def __init__(self, config: PipelineConfig, client: models.ModelClient):
        self.config, self.client = config, client

    def screen(self, studies: DataFrame, stage: str) -> DataFrame:
        s = getattr(self.config.screening, stage)
        return models.screen(studies, self.client, stage, bool(s.get("confidence_reporting")), s.get("threshold"), s.get("model") or "")

    def screen_abstracts(self, studies: DataFrame) -> DataFrame:
        return self.screen(screening.screenable(studies, "abstract"), "abstract")

    def screen_fulltexts(self, studies: DataFrame) -> DataFrame:
        return self.screen(screening.screenable(studies, "fulltext"), "fulltext")


class Retriever(ABC):
    @abstractmethod
    def retrieve(self, studies: DataFrame) -> DataFrame:
        """Studies with availability, path and source of their full texts."""

    def missing(self, studies: DataFrame) -> DataFrame:
        """Studies in scope without a text."""
        return studies.where(F.coalesce("retrieval_in_scope", F.lit(False)) & ~F.coalesce("fulltext_available", F.lit(False)))


class LocalRetriever(Retriever):
    """Texts of local sources, given as dicts like those of the configuration. The
    first source that has a study wins."""

    def __init__(self, sources: list[dict]):
        self.sources = sources

    def texts(self, spark: SparkSession) -> DataFrame:
        """(pmid, path, body, source_name, source_pos); HTML is turned into text."""
        parts = []
        for k, s in enumerate(self.sources):
            name = s.get("source_name") or s.get("name") or s.get("root_path") or f"full_text_source_{k + 1}"
            rows = files.corpus(
                spark, s["root_path"], s.get("pmid_source", "file_name"), tuple(s.get("allowed_extensions") or (".txt",)), tuple(s.get("text_path_templates") or ()),
                s.get("json_filename", "identifiers.json"), s.get("json_pmid_key", "pmid"),
            )
            parts.append(rows.select(F.col("pmid_number").cast("string").alias("pmid"), "path", files.plain(F.col("path"), F.col("body")).alias("body"), F.lit(name).alias("source_name"), F.lit(k).alias("source_pos")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return relational.first_by(every, ["pmid"], [F.col("source_pos")])

    def points(self, spark: SparkSession) -> tuple[DataFrame, DataFrame] | None:
        """(analyses, tables) of all sources that have some, by pmid and source_pos."""
        made = []
        for k, s in enumerate(self.sources):
            if s.get("processed_data_path"):
                rows, tables = folder_points(spark, s["processed_data_path"], "pmid")
                rows, tables = (x.withColumn("pmid", F.col("pmid").cast("string")) for x in (rows, tables))
            elif s.get("coordinates_path_templates"):
                found = files.corpus(spark, s["root_path"], s.get("pmid_source", "folder_name"), templates=tuple(s["coordinates_path_templates"]), json_name=s.get("json_filename", "identifiers.json"), json_key=s.get("json_pmid_key", "pmid"))
                raw = found.select(F.col("pmid_number").cast("string").alias("path"), F.from_json("body", schemas.COORDINATES_JSON)["studyset"].alias("studyset"))
                rows, tables = (x.withColumnRenamed("path", "pmid") for x in files.nested_coordinates(raw))
                rows, tables = rows.withColumn("parsed", F.lit(False)), tables.select("*", *[F.lit(None).cast("string").alias(c) for c in ("table_caption", "table_foot", "table_data_path", "table_raw_path")])
            else:
                continue
            made.append((shaped(rows, schemas.ANALYSIS, "analysis_pos", k), shaped(tables, schemas.TABLE, "table_pos", k)))
        if not made:
            return None
        return tuple(relational.union_ids([m[k] for m in made]) for k in (0, 1))

    def retrieve(self, studies: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """``texts``: what ``texts`` gave before, if it is stored."""
        found = (self.texts(studies.sparkSession) if texts is None else texts).select("pmid", F.col("path").alias("_path"), F.col("source_name").alias("_source"))
        joined = studies.join(found, "pmid", "left")
        got = F.col("_path").isNotNull() & F.coalesce("retrieval_in_scope", F.lit(False))
        return (
            joined.withColumn("full_text_path", F.when(got, F.col("_path")).otherwise(F.col("full_text_path")))
            .withColumn("full_text_source", F.when(got, F.col("_source")).otherwise(F.col("full_text_source")))
            .withColumn("fulltext_available", got | F.coalesce("fulltext_available", F.lit(False)))
            .withColumn("retrieved_at", F.when(got, F.current_timestamp()).otherwise(F.col("retrieved_at")))
            .drop("_path", "_source")
        )


def folder_points(spark: SparkSession, folder: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(analyses, tables) of coordinates.csv and tables.csv of a folder, by ``key``; a
    file that is not there has no rows."""
    root = folder.rstrip("/")
    coordinates, described = (csv_sets.member(spark, root, f"{name}.csv") for name in ("coordinates", "tables"))
    if files.exists(spark, coordinates):
        points = files.coordinates(spark, coordinates, key)
    else:
        points = spark.createDataFrame([], f"{key} long, table_id string, table_label string, row_pos long, x double, y double, z double")
    rows = retrieval.group_coordinates(points, key)
    if files.exists(spark, described):
        tables = files.tables(spark, described, root, key)
    else:
        tables = spark.createDataFrame([], f"{key} long, table_pos long, table_id string, table_label string, table_caption string, table_foot string, table_data_path string, table_raw_path string")
    bodies = files.texts(spark, root).withColumn("path", F.regexp_replace("path", r"^file:/*", "/"))
    return rows, files.raw_tables(tables.withColumn("raw_table", F.lit(None).cast("string")), bodies)


def shaped(rows: DataFrame, kind, pos: str, source: int, key: str = "pmid") -> DataFrame:
    """``rows`` with the fields of a nested record, behind key, place and source."""
    have = {c.lower() for c in rows.columns}
    values = lambda p: F.struct(p["coordinates"].alias("coordinates"), p["space"].alias("space"), F.array().cast("array<struct<value_text:string,value_num:double,kind:string>>").alias("values"))
    field = lambda f: F.transform("points", values).alias("points") if f.name == "points" else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
    return rows.select(key, F.col(pos).cast("long").alias("place"), F.lit(source).alias("source_pos"), *[field(f) for f in kind.fields])


class CsvFolderRetriever(Retriever):
    """Texts of a folder of CSV files, by pmcid: what a download tool leaves there.
    ``download`` is called first with the pmcids that the folder lacks, if given, and
    with ``n_docs`` of them at most; a folder that it returns is merged into this one."""

    def __init__(self, folder: str, download=None, n_docs: int | None = None):
        self.folder, self.download, self.n_docs = folder.rstrip("/"), download, n_docs

    def wanted(self, studies: DataFrame) -> DataFrame:
        """(pmcid) in scope that metadata.csv does not have."""
        have = csv_sets.read(studies.sparkSession, self.folder, "metadata.csv").select(files.number_key("pmcid").alias("pmcid"))
        scope = studies.where(F.col("pmcid").isNotNull() & F.coalesce("retrieval_in_scope", F.lit(False)))
        return relational.new_ids(scope.select("pmcid"), have, "pmcid")

    def retrieve(self, studies: DataFrame) -> DataFrame:
        if self.download is not None:
            got = self.download(retrieval.capped(self.wanted(studies), self.n_docs))
            if isinstance(got, str):
                csv_sets.merge(studies.sparkSession, self.folder, got)
        rows = retrieval.mark_retrieved(studies, self.texts(studies.sparkSession))
        analyses, tables = (shaped(x, kind, pos, 0, "pmcid").drop("source_pos") for x, kind, pos in zip(folder_points(studies.sparkSession, self.folder, "pmcid"), (schemas.ANALYSIS, schemas.TABLE), ("analysis_pos", "table_pos")))
        rows = retrieval.attach(rows, analyses, "pmcid", "analyses", "place", True)
        return retrieval.attach(rows, tables, "pmcid", "activation_tables", "place", True)

    def texts(self, spark: SparkSession) -> DataFrame:
        """(pmcid, body) of text.csv, one for each pmcid: of several the first by text."""
        rows = csv_sets.read(spark, self.folder, "text.csv").select(files.number_key("pmcid").alias("pmcid"), "body")
        return rows.where("pmcid is not null").groupBy("pmcid").agg(F.min("body").alias("body"))

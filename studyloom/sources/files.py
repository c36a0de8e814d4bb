"""File sources: local corpora, CSV folders, caches, the study set; explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom import schemas
from studyloom.functions import text as tx
from studyloom.functions.readable import readable

# What the table reader takes for a missing cell.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, body) of all files below a folder."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def corpus(spark: SparkSession, root: str, pmid_source: str = "file_name", extensions: tuple[str, ...] = (".txt",), templates: tuple[str, ...] = (), json_name: str = "identifiers.json", json_key: str = "pmid") -> DataFrame:
    """(pmid_number, path, body): one text for each pmid. Names that are no whole
    number are left out, and so is 0. Of several templates the first that exists wins."""
    files = texts(spark, root)
    if pmid_source == "file_name":
        named = files.where(tx.suffix(F.col("path")).isin(*extensions)).withColumn("pmid_number", tx.whole_number(tx.stem(F.col("path"))))
        return _real(named.withColumn("rank", F.lit(0)))
    base = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    depth = len(root.removeprefix("file://").rstrip("/").split("/"))
    parts = F.split(base, "/")
    inner = files.select("path", "body", parts[depth].alias("folder"), F.array_join(F.slice(parts, depth + 2, F.greatest(F.size(parts) - depth - 1, F.lit(0))), "/").alias("rest"))
    ranks = F.array(*[F.lit(t) for t in templates])
    found = inner.withColumn("rank", F.array_position(ranks, F.col("rest"))).where("rank > 0")
    if pmid_source == "folder_name":
        return _real(found.withColumn("pmid_number", tx.whole_number(F.col("folder"))))
    if pmid_source != "json":
        raise ValueError(f"unknown pmid_source: {pmid_source}")
    ids = inner.where(F.col("rest") == json_name).select("folder", tx.whole_number(F.get_json_object("body", f"$.{json_key}")).alias("pmid_number"))
    return _real(found.join(ids, "folder"))


def _real(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.coalesce(F.col("pmid_number") != 0, F.lit(False)))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("pmid_number").orderBy("rank", "path")))
    return ranked.where("_r = 1").select("pmid_number", "path", "body")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns with quoted line breaks; missing cells are null.
    Types come from the columns' readers, never from inference."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def number_key(x: str):
    """Ids as whole numbers: a column with gaps may print them as 1.0."""
    return F.regexp_replace(F.col(x), r"\.0$", "").try_cast("bigint")


def coordinates(spark: SparkSession, path: str, key: str = "pmcid") -> DataFrame:
    """(key, table_id, table_label, row_pos, x, y, z) of coordinates.csv."""
    raw = require(csv(spark, path), [key, "table_id", "table_label", "x", "y", "z"], "coordinates")
    return raw.select(number_key(key).alias(key), "table_id", "table_label", F.monotonically_increasing_id().alias("row_pos"), *[F.col(c).try_cast("double").alias(c) for c in "xyz"])


def tables(spark: SparkSession, path: str, root: str, key: str = "pmcid") -> DataFrame:
    """Table metadata of tables.csv; paths are put behind ``root``."""
    raw = require(csv(spark, path), [key, "table_id", "table_label", "table_caption", "table_foot"], "tables")
    if not {"table_raw_file", "table_data_file"} & set(raw.columns):
        raise ValueError("tables lacks table_raw_file and table_data_file")
    file = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(root.rstrip("/") + "/"), F.col(c))) if c in raw.columns else F.lit(None).cast("string")
    return raw.select(
        number_key(key).alias(key), F.monotonically_increasing_id().alias("table_pos"), "table_id", "table_label", "table_caption", "table_foot",
        file("table_data_file").alias("table_data_path"), file("table_raw_file").alias("table_raw_path"),
    )


def coordinates_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(analyses, tables) of nested files, with the file's path as key."""
    return nested_coordinates(spark.read.schema(schemas.COORDINATES_JSON).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "studyset"))


def nested_coordinates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analyses, tables) of the contents of nested files (path, studyset)."""
    raw = raw.select("path", F.explode("studyset.studies").alias("s"))
    rows = raw.select("path", F.posexplode("s.analyses").alias("analysis_pos", "a"))
    points = F.transform("a.points", lambda p: F.struct(p["coordinates"].alias("coordinates"), p["space"].alias("space")))
    analyses = rows.select("path", "analysis_pos", F.col("a.metadata.table_id").alias("table_id"), F.col("a.name").alias("name"), F.col("a.metadata.table_label").alias("description"), points.alias("points"))
    found = rows.select("path", F.col("analysis_pos").alias("table_pos"), F.col("a.metadata.table_id").alias("table_id"), F.col("a.metadata.table_label").alias("table_label"), F.col("a.metadata.raw_table_xml").alias("raw_table"))
    return analyses, found


def raw_tables(tables: DataFrame, bodies: DataFrame) -> DataFrame:
    """Tables with their text: what is there, else the raw file, else the data file."""
    for column in ("table_raw_path", "table_data_path"):
        body = bodies.select(F.col("path").alias(column), F.col("body").alias(f"_{column}"))
        tables = tables.join(body, column, "left")
    have = F.col("raw_table") if "raw_table" in tables.columns else F.lit(None).cast("string")
    return tables.withColumn("raw_table", F.coalesce(have, "_table_raw_path", "_table_data_path")).drop("_table_raw_path", "_table_data_path")


def plain(path: Column, body: Column) -> Column:
    """Text of a file: that of its article if it is HTML by its name, else as it is."""
    return F.when(F.lower(tx.suffix(path)).isin(".html", ".htm"), readable(body)).otherwise(body)


def fulltexts(studies: DataFrame, bodies: DataFrame, text_csv: DataFrame | None = None) -> DataFrame:
    """(pmid, body): the study's own file (HTML is turned into text), else its row of
    text.csv by pmcid."""
    own = studies.join(bodies.withColumnRenamed("path", "full_text_path"), "full_text_path", "left")
    body = plain(F.col("full_text_path"), F.col("body"))
    if text_csv is None:
        return own.select("pmid", body.alias("body"))
    by_id = text_csv.select(number_key("pmcid").alias("pmcid"), F.col("body").alias("_csv")).groupBy("pmcid").agg(F.min("_csv").alias("_csv"))
    return own.join(by_id, "pmcid", "left").select("pmid", F.coalesce(body, "_csv").alias("body"))


def search_cache(spark: SparkSession, path: str) -> DataFrame:
    """Studies of a stored search; states in any spelling become current ones."""
    from studyloom.functions.status import normalised

    schema = "struct<studies:array<struct<pmid:string,title:string,abstract:string,authors:array<string>,journal:string,publication_date:string,doi:string,keywords:array<string>,status:string,pmcid:bigint>>,timestamp:string>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("f")).select(F.posexplode("f.studies").alias("pos", "s")).select("pos", "s.*")
    return rows.withColumn("status", F.coalesce(normalised(F.col("status")), F.lit("pending")))


def screening_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored screening results, the last of each study; an unreadable file has none."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.SCREENING_FILE).alias("f"))
    rows = rows.select(F.posexplode("f.screening_results").alias("pos", "r")).select("pos", "r.*")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("study_id", "screening_type").orderBy(F.desc("pos")))).where("_r = 1").drop("_r")


def annotation_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored decisions with their place; a file with a bad item counts as none."""
    from pyspark.sql import types as T

    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(schemas.DECISION)).alias("f"))
    whole = rows.where(F.forall("f", lambda d: d["analysis_id"].isNotNull() & d["annotation_name"].isNotNull() & d["include"].isNotNull()))
    return whole.select(F.posexplode("f").alias("pos", "d")).select("pos", "d.*")


def include_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a file, one on each line."""
    return spark.read.text(path).select(tx.strip(F.col("value")).alias("id")).where("id <> ''").distinct()


def nimads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(points, notes) of an exported study set and its annotation. Points keep the name
    of their space. The annotation is one object or a list of one."""
    sets = spark.read.schema(schemas.NIMADS_STUDYSET).json(f"{folder}/nimads_studyset.json", multiLine=True)
    analyses = sets.select(F.explode("studies").alias("s")).select(F.col("s.id").alias("study_id"), F.explode("s.analyses").alias("a"))
    points = analyses.select("study_id", F.col("a.id").alias("analysis_id"), F.explode("a.points").alias("p"))
    points = points.select("study_id", "analysis_id", *[F.try_element_at("p.coordinates", F.lit(k + 1)).alias(c) for k, c in enumerate("xyz")], F.col("p.space").alias("space"))
    raw = spark.read.text(f"{folder}/nimads_annotation.json", wholetext=True).select(F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))).alias("v"))
    from pyspark.sql import types as T

    first = raw.select(F.from_json("v", T.ArrayType(schemas.NIMADS_ANNOTATION))[0].alias("a"))
    keys = F.map_filter("a.note_keys", lambda _, kind: kind == "boolean")
    notes = first.select(keys.alias("k"), F.explode("a.notes").alias("n")).select("k", F.col("n.analysis").alias("analysis_id"), F.explode("n.note").alias("column", "value"))
    return points, notes.where(F.map_contains_key("k", F.col("column"))).select("column", "analysis_id", F.coalesce("value", F.lit(False)).alias("value"))


def coordinate_cache(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, analyses) of stored parsing results; an analysis without the mark
    counts as parsed."""
    schema = f"struct<studies:array<struct<pmid:string,analyses:{schemas.STUDY['analyses'].dataType.simpleString()}>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("f")).select(F.explode("f.studies").alias("s")).select("s.*")
    return rows.withColumn("analyses", F.transform("analyses", lambda a: a.withField("parsed", F.coalesce(a["parsed"], F.lit(True)))))


def with_cached_analyses(studies: DataFrame, cached: DataFrame) -> DataFrame:
    """Stored analyses for studies that have no parsed one, of any state."""
    parsed = F.coalesce(F.exists("analyses", lambda a: F.coalesce(a["parsed"], F.lit(False))), F.lit(False))
    one = cached.dropDuplicates(["pmid"]).select("pmid", F.col("analyses").alias("_cached"))
    joined = studies.join(one, "pmid", "left")
    return joined.withColumn("analyses", F.when(~parsed & F.col("_cached").isNotNull(), F.col("_cached")).otherwise(F.col("analyses"))).drop("_cached")


def criteria_ids(spark: SparkSession, path: str) -> DataFrame:
    """(scope, kind, id, text) of a stored criteria mapping; an unreadable file has none."""
    part = "map<string,string>"
    kinds = f"struct<inclusion:{part},exclusion:{part}>"
    schema = f"struct<screening:struct<abstract:{kinds},fulltext:{kinds}>,annotation:struct<global:{kinds},local:map<string,{kinds}>>>"
    f = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("f"))
    fixed = F.create_map(F.lit("abstract"), F.col("f.screening.abstract"), F.lit("fulltext"), F.col("f.screening.fulltext"), F.lit("global"), F.col("f.annotation.global"))
    scopes = f.select(F.explode(F.map_concat(fixed, F.coalesce(F.col("f.annotation.local"), F.create_map().cast(f"map<string,{kinds}>")))).alias("scope", "k"))
    lists = scopes.select("scope", F.explode(F.create_map(F.lit("inclusion"), F.col("k.inclusion"), F.lit("exclusion"), F.col("k.exclusion"))).alias("kind", "m"))
    return lists.select("scope", "kind", F.explode("m").alias("id", "text"))


def table_files(spark: SparkSession, folder: str, info: DataFrame | None = None) -> DataFrame:
    """(table_id, path, raw_table, table_caption...) of the CSV files below a folder;
    ``info`` has ``table_data_file`` and metadata, the last row of a file counts."""
    rows = texts(spark, folder).where(tx.suffix(F.col("path")) == ".csv")
    rows = rows.where(tx.file_name(F.col("path")).rlike("^pmcid")).select(tx.stem(F.col("path")).alias("table_id"), "path", F.col("body").alias("raw_table"))
    if info is None:
        return rows
    kept = info.withColumn("_pos", F.monotonically_increasing_id()).groupBy(tx.file_name(F.col("table_data_file")).alias("_file")).agg(*[F.max_by(c, "_pos").alias(c) for c in info.columns if c not in ("table_data_file", "table_id")])
    joined = rows.withColumn("_file", tx.file_name(F.col("path"))).join(kept, "_file", "left").drop("_file")
    return joined.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c.startswith("table_") and c != "table_id" else F.col(c) for c in joined.columns])

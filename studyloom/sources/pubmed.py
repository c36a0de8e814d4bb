"""Search service records: query text, id lists, XML documents, remote calls."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.functions import text as tx

#: Fixed values.
MAX_IDS = 10_000
FETCH_BATCH, CONVERT_BATCH = 100, 200
EUTILS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
IDCONV = "https://www.ncbi.nlm.nih.gov/pmc/utils/idconv/v1.0"
ARTICLES = (
    "pmid string, title string, abstract string, journal string, doi string, pmcid string, year string, month string, day string, "
    "authors array<struct<fore:string,last:string>>, keywords array<string>, error string"
)


def build_query(base: str, date_from: str | None = None, date_to: str | None = None) -> str:
    """The query with its date range; an open end is year 1900 or 3000."""
    if not (date_from or date_to):
        return base
    low, high = date_from or "1900", date_to or "3000"
    return f'{base} AND ("{low}"[Date - Publication] : "{high}"[Date - Publication])'


def get(url: str, params: dict[str, str], tries: int = 3, wait: float = 1.0, opener: Callable | None = None) -> bytes:
    """GET with retries; waits double after each try, and the last error is raised."""
    from urllib.parse import urlencode
    from urllib.request import urlopen

    for attempt in range(tries):
        try:
            with (opener or urlopen)(f"{url}?{urlencode(params)}") as response:
                return response.read()
        except OSError:
            if attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


def search_ids(spark: SparkSession, query: str, max_results: int | None = None, email: str | None = None, fetch: Callable[..., bytes] = get) -> DataFrame:
    """(pmid, rank): ids of a query by relevance. The service caps the list itself."""
    params = {"db": "pubmed", "term": query, "retmax": str(max_results or MAX_IDS), "sort": "relevance", "retmode": "json"}
    if email:
        params["email"] = email
    ids = json.loads(fetch(f"{EUTILS}/esearch.fcgi", params))["esearchresult"]["idlist"]
    return spark.createDataFrame(list(zip(ids, range(len(ids)))), "pmid string, rank int")


def read_ids(spark: SparkSession, pmids: list[str] | None = None, path: str | None = None) -> DataFrame:
    """(pmid, pos) of a list, or of the lines of a file that aren't empty; a list wins."""
    if pmids:
        return spark.createDataFrame([(str(p), k) for k, p in enumerate(pmids)], "pmid string, pos long")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), tx.strip(F.col("value")).alias("pmid"))
    return lines.where("pmid <> ''").select("pmid", "pos")


def fetch_xml(ids: DataFrame, fetch: Callable[..., bytes] = get, pause: float = 0.5) -> DataFrame:
    """(pmids, xml, error) for batches of ids. A batch that fails is a row with its
    error, so the job goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), FETCH_BATCH):
                part = list(batch["pmid"][a : a + FETCH_BATCH])
                try:
                    xml, error = fetch(f"{EUTILS}/efetch.fcgi", {"db": "pubmed", "id": ",".join(part), "retmode": "xml"}).decode(), None
                except (OSError, ValueError) as e:
                    xml, error = None, str(e)
                yield pd.DataFrame({"pmids": [part], "xml": [xml], "error": [error]})
                time.sleep(pause)

    return ids.select("pmid").mapInPandas(run, "pmids array<string>, xml string, error string")


def shred(xml: str) -> Iterator[dict]:
    """Article records of a document; one that can't be read has an error."""
    try:
        articles = list(ElementTree.fromstring(xml).iter("PubmedArticle"))
    except ElementTree.ParseError as e:
        yield {"error": f"document: {e}"}
        return
    for a in articles:
        first = lambda path: a.findtext(f".//{path}")  # noqa: E731, B023
        ids = {x.get("IdType"): x.text for x in reversed(list(a.iter("ArticleId"))) if x.text}
        date = a.find(".//PubDate")
        part = lambda tag: date.findtext(tag) if date is not None else None  # noqa: E731, B023
        yield {
            "pmid": first("PMID"), "title": first("ArticleTitle"), "abstract": first("AbstractText"), "journal": first("Journal/Title"), "doi": ids.get("doi"), "pmcid": ids.get("pmc"),
            "year": part("Year"), "month": part("Month"), "day": part("Day"),
            "authors": [{"fore": x.findtext("ForeName"), "last": x.findtext("LastName")} for x in a.iter("Author")],
            "keywords": [x.text for x in a.iter("Keyword")], "error": None,
        }


def articles(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Raw article records of XML documents (first AbstractText and text before the
    first inner tag only, as a tree reader gives them)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ARTICLES.replace("struct<fore:string,last:string>", "x").split(", ")]
        for batch in batches:
            rows = [r for x in batch[column] if x for r in shred(x)]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return documents.select(column).mapInPandas(run, ARTICLES)


def studies(records: DataFrame) -> DataFrame:
    """Study columns of raw article records, with the defaults for what is absent."""
    c = F.col
    return records.where("error is null").select(
        F.coalesce("pmid", F.lit("Unknown")).alias("pmid"), F.coalesce("title", F.lit("Unknown Title")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.coalesce("journal", F.lit("Unknown Journal")).alias("journal"), tx.author_names(c("authors")).alias("authors"), c("doi"), tx.pmcid_number(c("pmcid")).alias("pmcid"),
        tx.prefer(tx.publication_date(c("year"), c("month"), c("day")), "Unknown Date").alias("publication_date"), tx.keywords(c("keywords")).alias("keywords"), F.lit("pending").alias("status"),
    )


def convert_ids(ids: DataFrame, fetch: Callable[..., bytes] = get, pause: float = 0.5) -> DataFrame:
    """(pmid, pmcid number) of the ids that the converter knows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), CONVERT_BATCH):
                try:
                    got = json.loads(fetch(IDCONV, {"ids": ",".join(batch["pmid"][a : a + CONVERT_BATCH]), "format": "json"})).get("records", [])
                except (OSError, ValueError):
                    got = []
                yield pd.DataFrame([(str(r.get("pmid")), r.get("pmcid")) for r in got], columns=["pmid", "pmcid"])
                time.sleep(pause)

    return ids.select("pmid").mapInPandas(run, "pmid string, pmcid string").select("pmid", tx.pmcid_number(F.col("pmcid")).alias("pmcid")).where("pmcid is not null")

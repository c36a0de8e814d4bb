"""The search service as a data source: ``spark.read.format("studyloom_pubmed")``.

Filters on ``published`` become the date range of the query, the query is asked
once while the read is planned, and each partition fetches a range of the ids:

    spark.dataSource.register(PubMedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("studyloom_pubmed").option("term", "memory").load().where("published >= '2020/01/01'")

Options: term, max_results, email, ids_a_partition.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from studyloom.sources import pubmed

#: ``rank`` is the place in the order of relevance. ``published`` has the form
#: yyyy/mm/dd, as far as the record gives it, else null.
SCHEMA = "pmid string, rank int, published string, title string, abstract string, journal string, doi string, pmcid string, year string, month string, day string, authors array<struct<fore:string,last:string>>, keywords array<string>"
# Months as records name them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def published(year: str | None, month: str | None, day: str | None) -> str | None:
    """The date of a record as text that sorts by time; null without a year."""
    if not year:
        return None
    name = (month or "").strip().lower()[:3]
    number = MONTHS.index(name) + 1 if name in MONTHS else int(month) if (month or "").strip().isdigit() else None
    parts = [year.strip()] + ([f"{number:02d}"] if number else []) + ([f"{int(day):02d}"] if number and (day or "").strip().isdigit() else [])
    return "/".join(parts)


class Ids(InputPartition):
    """A range of the ids of a query, from the place ``first`` on."""

    def __init__(self, first: int, ids: list[str]):
        super().__init__((first, ids))
        self.first, self.ids = first, ids


class PubMedReader(DataSourceReader):
    """Reads one query. The range of dates that filters name is asked of the service,
    whose dates may be finer than the records': Spark applies the filters once more."""

    def __init__(self, options: dict, fetch: Callable[..., bytes]):
        self.options, self.fetch, self.low, self.high = options, fetch, None, None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) and f.attribute == ("published",) and f.value:
                self.low = max(self.low or "", f.value)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual) and f.attribute == ("published",) and f.value:
                self.high = min(self.high or "9999", f.value)
            yield f

    def query(self) -> str:
        return pubmed.build_query(self.options["term"], self.low, self.high)

    def partitions(self) -> list[Ids]:
        params = {"db": "pubmed", "term": self.query(), "retmax": str(self.options.get("max_results") or pubmed.MAX_IDS), "sort": "relevance", "retmode": "json"}
        if self.options.get("email"):
            params["email"] = self.options["email"]
        ids = json.loads(self.fetch(f"{pubmed.EUTILS}/esearch.fcgi", params))["esearchresult"]["idlist"]
        size = int(self.options.get("ids_a_partition") or pubmed.FETCH_BATCH)
        return [Ids(k, ids[k : k + size]) for k in range(0, len(ids), size)] or [Ids(0, [])]

    def read(self, partition: Ids) -> Iterator[tuple]:
        for k in range(0, len(partition.ids), pubmed.FETCH_BATCH):
            part = partition.ids[k : k + pubmed.FETCH_BATCH]
            rank = {p: partition.first + k + n for n, p in enumerate(part)}
            xml = self.fetch(f"{pubmed.EUTILS}/efetch.fcgi", {"db": "pubmed", "id": ",".join(part), "retmode": "xml"}).decode()
            for a in pubmed.shred(xml):
                if a["error"]:
                    raise ValueError(a["error"])
                authors = [(x["fore"], x["last"]) for x in a["authors"]]
                yield (a["pmid"], rank.get(a["pmid"]), published(a["year"], a["month"], a["day"]), *(a[c] for c in ("title", "abstract", "journal", "doi", "pmcid", "year", "month", "day")), authors, a["keywords"])


class PubMedSource(DataSource):
    """See the module; a subclass may bring another ``fetch``."""

    fetch = staticmethod(pubmed.get)

    @classmethod
    def name(cls) -> str:
        return "studyloom_pubmed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PubMedReader:
        if not (self.options.get("term") or "").strip():
            raise ValueError("studyloom_pubmed needs the option term")
        return PubMedReader(dict(self.options), self.fetch)

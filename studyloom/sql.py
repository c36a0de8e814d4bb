"""Table functions for SQL users: ``register(spark)``, then
``SELECT ... FROM answers, LATERAL parse_analyses(payload)``.

``parse_analyses`` and ``parse_decisions`` are SQL functions that Spark inlines, so
their plans have no Python; ``shred_articles`` reads XML, which needs a tree reader.
A payload or document that is null or can't be read gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from studyloom.functions.text import NO, YES
from studyloom.operators.annotation import PAYLOAD
from studyloom.operators.models import ANALYSES
from studyloom.sources import pubmed

_POINTS = "array<struct<coordinates:array<double>,space:string,values:array<struct<value_text:string,value_num:double,kind:string>>>>"
_STRIPPED = "regexp_replace({}, '^\\\\s+|\\\\s+$', '')"
_WORDS = {True: ", ".join(f"'{w}'" for w in YES), False: ", ".join(f"'{w}'" for w in NO)}

FUNCTIONS = {
    # points without three numbers go
    "parse_analyses": f"""(payload STRING) RETURNS TABLE (pos INT, name STRING, description STRING, points {_POINTS})
    RETURN SELECT pos, a.name, a.description, transform(filter(coalesce(a.points, array()), p -> size(p.coordinates) = 3 AND forall(p.coordinates, c -> c IS NOT NULL)),
      p -> named_struct('coordinates', p.coordinates, 'space', p.space, 'values', transform(p.values, v -> named_struct('value_text', v.value, 'value_num', try_cast(v.value AS DOUBLE), 'kind', v.kind))))
    FROM (SELECT posexplode(from_json(payload, '{ANALYSES}').analyses) AS (pos, a))""",
    # one row for each annotation of each analysis; include is null where it is no boolean
    "parse_decisions": f"""(payload STRING) RETURNS TABLE (pos INT, analysis_id STRING, annotation_name STRING, include BOOLEAN, reasoning STRING)
    RETURN SELECT i * 100000 + j, {_STRIPPED.format("d.analysis_id")}, a.annotation_name,
      CASE WHEN lower({_STRIPPED.format("a.include")}) IN ({_WORDS[True]}) THEN true WHEN lower({_STRIPPED.format("a.include")}) IN ({_WORDS[False]}) THEN false END, a.reasoning
    FROM (SELECT posexplode(from_json(payload, '{PAYLOAD}').decisions) AS (i, d)), LATERAL posexplode(d.annotations) AS t(j, a)""",
}


class ShredArticles:
    """Article records of an XML document."""

    def eval(self, xml: str) -> Iterator[tuple]:
        names = ("pmid", "title", "abstract", "journal", "doi", "pmcid", "year", "month", "day", "authors", "keywords", "error")
        for r in pubmed.shred(xml) if xml else ():
            people = [(x["fore"], x["last"]) for x in r.get("authors") or []]
            yield tuple(people if n == "authors" else r.get(n) for n in names)


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("shred_articles", udtf(ShredArticles, returnType=pubmed.ARTICLES))

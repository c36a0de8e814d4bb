"""Scalar functions against hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from studyloom.functions import coords, html, prompts, status, text


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.strip, "\t a b\n", "a b"),
        (text.analysis_name, " 'a' \"b\"\n", "a b"),
        (text.analysis_name, " '' ", None),
        (text.criteria_namespace, "affiliation-attachment (x)", "AFFILIATION_ATTACHMENT_X"),
        (text.criteria_namespace, "!!", "ANNOTATION"),
        (text.pmcid_number, "PMC123", 123),
        (text.pmcid_number, "PMCx", None),
        (text.publication_year, "2023-01-05", 2023),
        (text.publication_year, "2023 Jan 05", None),
        (text.publication_year, "2023.7", None),
        (text.boolean, " YES ", True),
        (text.boolean, "0", False),
        (text.boolean, "maybe", None),
        (text.not_nan, "NaN", None),
        (text.field_label, "sample_size", "Sample Size"),
        (text.stem, "/a/b.c/12.34.txt", "12.34"),
        (text.suffix, "/a/b.c/12.TXT", ".TXT"),
        (text.stem, "/a/.hidden", ".hidden"),
        (text.is_criteria_id, "GLOBAL_I12", True),
        (text.is_criteria_id, "I1x", False),
        (text.first_text, "A <i>b</i> c", "A "),
        (status.normalised, " INCLUDED", "included_abstract"),
        (status.normalised, "Fulltext_Incomplete", "fulltext_incomplete"),
        (status.normalised, "?", None),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, "string", f) == want


@pytest.mark.parametrize(("value", "want"), [(2.5, 2), (3.5, 4), (-2.5, -2), (0.5, 0), (-0.6, -1)])
def test_half_even(spark, value, want):
    assert one(spark, value, "double", coords.rounded) == want


def test_points(spark):
    points = [([1.0, 2.0, 3.0], True, True), ([1.0, 2.0], False, False), ([1.0, None, 2.0], False, False), ([1.0, math.nan, 2.0], True, False), ([1.0, math.inf, 2.0], True, False), (None, False, False)]
    rows = spark.createDataFrame(points, "c array<double>, valid boolean, finite boolean").select("*", coords.valid_point(F.col("c")).alias("v"), coords.finite_point(F.col("c")).alias("f")).collect()
    assert all((r["v"], r["f"]) == (r["valid"], r["finite"]) for r in rows)


def test_threshold_wins_unless_incomplete(spark):
    rows = spark.createDataFrame([("INCLUDED", 0.845, False, "r"), ("INCLUDED", 0.74, True, "r"), ("INCLUDED", 0.95, False, "r")], "d string, c double, i boolean, r string")
    got = rows.select(status.with_threshold(F.col("d"), F.col("c"), F.col("i"), "fulltext", True, 0.9).alias("d"), status.threshold_reason(F.col("r"), F.col("c"), 0.9).alias("t")).collect()
    assert [r["d"] for r in got] == ["EXCLUDED", "FULLTEXT_INCOMPLETE", "INCLUDED"]
    assert got[0]["t"] == f"Confidence {0.845:.2f} below threshold 0.9. r"


def test_html(spark):
    page = "<p class='x'>One &amp; two</p><script>p()</script><!-- no --><h2>Head</h2><p>Last"
    assert one(spark, page, "string", html.paragraphs) == "One & two\n\nHead\n\nLast"
    assert "script" not in one(spark, page, "string", html.cleaned)


def test_prompts(spark):
    stage = {"objective": "find", "criteria_mapping": {"inclusion": {"I1": "human"}, "exclusion": {"E1": "review"}}, "confidence_reporting": True}
    row = spark.createDataFrame([("t", None, None)], "t string, a string, b string")
    got = row.select(prompts.screening(stage, "abstract", F.col("t"), F.col("a")).alias("p"), prompts.screening(stage, "fulltext", F.col("t"), F.col("a"), body=F.col("b")).alias("q")).first()
    assert "I1: human" in got["p"] and "E1: review" in got["p"] and "No abstract available" in got["p"] and "confidence" in got["p"]
    assert got["q"] is None


def test_article_text(spark):
    from studyloom.functions.readable import article_text, readable

    long = "The hippocampus, as shown before, was active in both groups of this study."
    page = f"""<html><head><title>t</title><style>p {{}}</style></head><body><nav><ul><li>Home is a menu item, of some length, yes</li></ul></nav>
      <div id="main"><h1>Title &amp; more</h1><div><p>{long}</p><p>{long} Again.</p></div><ul><li>a short item</li></ul><script>var x = "<p>no</p>";</script></div>
      <div class="side"><p><a href="x">A linked paragraph, long enough to count if it were text</a></p></div></body></html>"""
    assert article_text(page) == f"{long}\n\n{long} Again."
    assert article_text("<html><script>x</script><p>Hello</p></html>") == "Hello"
    assert [article_text(x) for x in (None, "", "plain words", "<div><<>broken <p>open", "<script>never closed")] == [None, "", "plain words", "<<>broken\n\nopen", ""]
    rows = spark.createDataFrame([(page,), (None,)], "html string").select(readable(F.col("html")).alias("t")).collect()
    assert rows[0]["t"].startswith("The hippocampus") and rows[1]["t"] is None

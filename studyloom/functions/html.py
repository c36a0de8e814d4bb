"""Text of HTML full texts by regular expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.text import strip

#: Elements and attributes that go.
DROPPED = ("script", "style", "noscript", "iframe", "svg", "canvas")
ATTRIBUTES = ("style", "onclick", "class", "id", "aria-hidden", "aria-label")


def cleaned(html: Column) -> Column:
    """Markup without comments, scripts, styles and presentational attributes."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>|<{tag}\b[^>]*/?>", "")
    return F.regexp_replace(out, rf"(?i)\s(?:{'|'.join(ATTRIBUTES)})\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")


def unescaped(text: Column) -> Column:
    """The five named references and the no-break blank; the ampersand last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def paragraphs(html: Column) -> Column:
    """Texts of paragraphs and headings, stripped, joined by blank lines."""
    parts = F.regexp_extract_all(cleaned(html), F.lit(r"(?is)<(p|h[1-6])(?:\s[^>]*)?>(.*?)(?=</\1\s*>|<(?:p|h[1-6])(?:\s[^>]*)?>|$)"), F.lit(2))
    texts = F.transform(parts, lambda x: strip(unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", ""))))
    return F.array_join(F.filter(texts, lambda x: x != ""), "\n\n")

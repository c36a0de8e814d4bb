"""Scalar text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ids that a model may cite: an optional namespace, I or E, a number.
CRITERIA_ID = r"^(?:[A-Z0-9_]+_)?[IE][0-9]+$"
YES, NO = ("true", "yes", "1"), ("false", "no", "0")


def strip(x: Column) -> Column:
    """Without white space of any kind at either end (``trim`` knows blanks only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def filled(x: Column) -> Column:
    """True where a text has more than white space; never null."""
    return F.coalesce(x.rlike(r"\S"), F.lit(False))


def prefer(x: Column, default: str) -> Column:
    """The text, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def analysis_name(x: Column) -> Column:
    """A name without quotes and outer white space; null if nothing is left."""
    return F.nullif(strip(F.translate(x, "'\"", "")), F.lit(""))


def criteria_namespace(name: Column) -> Column:
    """Upper-case prefix of criteria ids: other characters become one underscore."""
    squeezed = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.upper(squeezed), F.lit("")), F.lit("ANNOTATION"))


def pmcid_number(x: Column) -> Column:
    """Number of a PMCID with or without its prefix; null if it is none."""
    return F.regexp_replace(x, "^PMC", "").try_cast("bigint")


def whole_number(x: Column, kind: str = "bigint") -> Column:
    """The number that a text of digits alone spells, else null."""
    return F.when(x.rlike("^[0-9]+$"), x.try_cast(kind))


def publication_year(date: Column) -> Column:
    """The part before the first hyphen if it is a whole number: dates of the
    search service, which have blanks, give null."""
    part = strip(F.split(date, "-")[0])
    return F.when(part.rlike(r"^[+-]?[0-9]+$"), part.try_cast("int"))


def publication_date(year: Column, month: Column, day: Column) -> Column:
    """``Y M D`` with empty parts left blank, stripped."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return strip(F.concat(text(year), F.lit(" "), text(month), F.lit(" "), text(day)))


def author_names(authors: Column, fore: str = "fore", last: str = "last") -> Column:
    """``Fore Last`` of each author who has a last name."""
    named = F.filter(authors, lambda a: a[last].isNotNull())
    return F.transform(named, lambda a: F.concat_ws(" ", F.nullif(a[fore], F.lit("")), a[last]))


def joined(items: Column, sep: str = ", ") -> Column:
    """Items in one text; null for no items."""
    return F.when(F.size(items) > 0, F.concat_ws(sep, items))


def keywords(items: Column) -> Column:
    return F.filter(items, lambda k: k.isNotNull() & (k != ""))


def not_nan(x: Column) -> Column:
    """Null for the text nan in any case."""
    return F.when(F.lower(strip(x)) != "nan", x)


def boolean(x: Column) -> Column:
    """True or false as a model may write them; null for anything else."""
    t = F.lower(strip(x.cast("string")))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def is_criteria_id(x: Column) -> Column:
    return F.coalesce(x.rlike(CRITERIA_ID), F.lit(False))


def field_label(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def first_text(xml: Column) -> Column:
    """Text before the first inner tag."""
    return F.regexp_extract(xml, "^[^<]*", 0)

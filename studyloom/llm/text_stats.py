"""Statistics of whole texts, counted in one pass per text in Arrow batches."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.memory import trim
from studyloom.llm.storage import with_columns

# Fixed values.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
MARKS = b"!\"'(),-./:;=?@[\\]^_`{}~+"

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_unique", "n_upper", "n_lower", "n_digits", "n_marks", "longest_word",
)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in windows which the text has twice or more."""
    if len(words) < window:
        return 0
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered, upto = 0, 0
    for i, g in enumerate(grams):
        if g in often:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def stats(text: str | None) -> tuple[int, ...]:
    """FIELDS of one text; null counts as the empty text.

    Words are runs without ASCII white space, lines are parts between newlines
    that have a word, letters and digits are the ASCII ones."""
    if not text:
        return (0,) * len(FIELDS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    size = len(raw)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        size - len(raw.translate(None, UPPER)),
        size - len(raw.translate(None, LOWER)),
        size - len(raw.translate(None, DIGITS)),
        size - len(raw.translate(None, MARKS)),
        max(map(len, words), default=0),
    )


_TYPE = T.StructType([T.StructField(f, T.LongType(), False) for f in FIELDS])


@F.arrow_udf(_TYPE)
def _stats(column: pa.Array) -> pa.Array:
    rows = [stats(x.as_py()) for x in column]
    trim()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(FIELDS), FIELDS)


def text_stats(text: Column) -> Column:
    """A struct with FIELDS."""
    return _stats(text)


def add_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``stats``, in place of any column of that name."""
    return with_columns(docs, {"stats": text_stats(F.col(text))})

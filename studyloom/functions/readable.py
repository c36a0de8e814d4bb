"""Text of HTML full texts: the container whose paragraphs speak for it.

A page streams through the standard library's parser in Arrow batches. Each
paragraph, heading, list item and cell is a block of its container. A block gives
its container and, by half, the next one out a score for its length and commas;
links take from it. The best container's blocks are the text. A page without
paragraphs is cleaned of its markup.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.functions.html import DROPPED

BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "blockquote", "dd", "dt", "figcaption"))
CONTAINERS = frozenset(("body", "main", "article", "section", "div", "table", "ul", "ol", "dl", "nav", "aside", "header", "footer", "form"))
#: Containers that are no part of an article.
OUTSIDE = frozenset(("nav", "aside", "footer", "form"))
#: Blocks with a larger share of their text in links give no score.
LINKS = 0.5
#: A block of fewer characters gives no score.
LEAST = 25
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_SPACE = re.compile(r"[ \t\r\n\f\v]+")


class _Reader(HTMLParser):
    """Blocks (containers from the outermost in, text, characters in links) of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[tuple[int, ...], str, int]] = []
        self.around: list[tuple[int, str]] = [(0, "")]
        self.text: list[str] = []
        self.made = self.links = self.linked = self.silent = 0

    def _flush(self) -> None:
        whole = _SPACE.sub(" ", "".join(self.text)).strip()
        if whole and not any(tag in OUTSIDE for _, tag in self.around):
            self.blocks.append((tuple(n for n, _ in self.around), whole, self.linked))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.silent += tag not in _VOID
            return
        if tag in BLOCKS or tag in CONTAINERS:
            self._flush()
        if tag in CONTAINERS:
            self.made += 1
            self.around.append((self.made, tag))
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.links += 1

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.silent = max(0, self.silent - 1)
            return
        if tag in BLOCKS or tag in CONTAINERS:
            self._flush()
        if tag in CONTAINERS:
            at = next((k for k in range(len(self.around) - 1, 0, -1) if self.around[k][1] == tag), 0)
            if at:
                del self.around[at:]
        elif tag == "a":
            self.links = max(0, self.links - 1)

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def done(self):
        self.close()
        self._flush()
        return self.blocks


def article_text(page: str | None) -> str | None:
    """Blocks of the best container, joined by blank lines; without a block that
    scores, all blocks; null for null, empty for a page without text."""
    if page is None:
        return None
    reader = _Reader()
    reader.feed(page)
    blocks = reader.done()
    score: dict[int, float] = {}
    for around, text, links in blocks:
        if len(text) >= LEAST and links <= LINKS * len(text):
            own = 1 + text.count(",") + min(len(text) / 100, 3)
            for k, n in enumerate(reversed(around[-2:])):
                score[n] = score.get(n, 0) + own / (k + 1)
    if not score:
        return "\n\n".join(text for _, text, _ in blocks)
    best = max(score, key=lambda n: (score[n], -n))
    return "\n\n".join(text for around, text, links in blocks if best in around and links <= LINKS * max(1, len(text)))


def readable(html: Column) -> Column:
    """Text of pages; see ``article_text``."""

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([article_text(x.as_py()) for x in column], pa.string())

    return run(html)

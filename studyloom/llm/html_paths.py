"""Main text of web pages by tag-path ratios.

Text blocks are grouped by their tag path from the root. Each path has the mean text
length and the mean punctuation of its blocks; both are smoothed over neighbouring
blocks, fused into one score per path by their product, and the paths over a share
of the weighted mean are content. Elements that never hold an article (menus,
footers, forms and the like, by name, role or class) are left out before; a class
that covers most of the page's text is not believed. If the page marks an article
or main region, only its paths compete, against a lower share. There a path stands
for itself, since an author's short blocks lie between long ones as an advert does,
and a list, table, quotation or listing is judged as a whole with its neighbours: its
cells are short by nature. A word within a longer class is one more ratio: it lowers
the score of its blocks.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.storage import with_columns

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "select", "xmp", "noembed", "noframes", "canvas", "audio", "video")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
NEVER = frozenset("head nav footer header aside form menu dialog fieldset button label search".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "head"}
SAME_LEVEL = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets disclaimer".split()
)

#: Blocks to either side that smoothing looks at.
RADIUS = 2
#: A path is content from this share of the text-weighted mean score on.
SHARE = 0.25
#: The share inside a marked region: a quarter of the mean in both ratios.
INSIDE = 0.0625
#: Elements inside a marked region that are judged as a whole.
WHOLE = frozenset("ul ol dl table pre blockquote figure".split())
#: What a word within a longer class leaves of a score.
DOUBT = 0.2
#: Paths with more of their text in links are not content.
LINKS = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of a tag; quotes may hold it. Nothing is tried twice.
_ATTRS = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+""")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def _excluded(tag: str, attrs: str, inside: bool) -> int:
    """3 if the element holds no article by its kind, 2 by its class or id, 1 if only a
    word within a longer class or id speaks against it (has-sidebar), 0 otherwise. A
    header ``inside`` a marked region is the article's own."""
    if tag in NEVER and not (inside and tag == "header"):
        return 3
    if not attrs or tag in ("html", "body"):
        return 0
    found = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if tag in ("article", "main") and name not in ("class", "id"):
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 3
        if name == "role" and value.lower() in ROLES:
            return 3
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 3
        if name in ("class", "id"):
            words = [x.lower() for x in value.split()]
            if any(x in NAMES for x in words) and not (tag == "header" and set(words) <= {"header", "hd"}):
                return 2
            if tag not in ("article", "main", *HEADINGS) and any(x.lower() in NAMES for x in _PARTS.findall(value)):
                found = 1
    return found


class Block:
    """A block of text: number and last tag of its path, characters in links, whether
    it lies in a marked region, whether a word within a class speaks against it, and
    the numbers of the outermost element that a class or id excludes and of the
    outermost one that is judged as a whole, or 0."""

    __slots__ = ("path", "tag", "text", "links", "region", "doubtful", "named", "whole")

    def __init__(self, path: int, tag: str, text: str, links: int, region: bool, doubtful: bool, named: int, whole: int):
        self.path, self.tag, self.text, self.links, self.region, self.doubtful, self.named, self.whole = path, tag, text, links, region, doubtful, named, whole


class _Open:
    """An open element."""

    __slots__ = ("tag", "state", "region", "path", "named", "whole")

    def __init__(self, tag: str, state: int, region: bool, path: int, named: int, whole: int):
        self.tag, self.state, self.region, self.path, self.named, self.whole = tag, state, region, path, named, whole


_ROOT = _Open("", 0, False, 0, 0, 0)
_ENDS_P = frozenset(("p", "div", "td", "li", "article", "section", "body"))


def _tags(page: str):
    """(start, end, closing, name, attributes) of tags, and (start, end, None, text,
    "") of what is no tag but markup, with the text it stands for. Linear in the page."""
    at, size = 0, len(page)
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, None, "", ""
        elif page.startswith("<![CDATA[", start) and (end := page.find("]]>", start)) >= 0:
            at = end + 3
            yield start, at, None, page[start + 9 : end], ""
        elif page[start + 1 : start + 2] in ("!", "?"):
            if (end := page.find(">", start)) < 0:
                return
            at = end + 1
            yield start, at, None, "", ""
        elif m := _NAME.match(page, start + 1):
            end = _ATTRS.match(page, m.end()).end()
            if page[end : end + 1] != ">" and (end := page.find(">", m.end())) < 0:
                return  # no tag ends behind here
            at = end + 1
            jump = yield start, at, bool(m.group(1)), m.group(2).lower(), page[m.end() : end]
            if jump is not None:
                at = jump
                yield at, at, None, "", ""
        else:
            at = start + 1


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, without those of elements that hold no article by
    their kind."""
    stack: list[_Open] = []
    open_of: dict[str, int] = {}
    numbers: dict[tuple[int, str], int] = {}
    out: list[Block] = []
    text: list[str] = []
    links, named_elements, wholes = 0, 0, 0
    leaf = _ROOT

    def flush() -> None:
        nonlocal links
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                block = next((e for e in reversed(stack) if e.tag in BLOCKS), _ROOT)
                out.append(Block(leaf.path, block.tag, joined, links, leaf.region, leaf.state == 1, leaf.named, leaf.whole))
            text.clear()
        links = 0

    def pop_to(k: int) -> None:
        if any(e.tag in BLOCKS for e in stack[k:]):
            flush()
        for e in stack[k:]:
            open_of[e.tag] -= 1
        del stack[k:]

    def data(piece: str) -> None:
        nonlocal links, leaf
        top = stack[-1] if stack else _ROOT
        if piece and top.state < 3:
            if not text or not leaf.path and not "".join(text).strip():
                leaf = top
            text.append(piece)
            if open_of.get("a"):
                links += len(piece.strip())

    at = 0
    tags = _tags(page)
    found = next(tags, None)
    while found is not None:
        start, end, closing, tag, attrs = found
        jump = None
        data(page[at:start])
        at = end
        if closing is None:
            data(tag)
        elif closing:
            if open_of.get(tag):
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            elif tag in BLOCKS:
                flush()
        elif tag in RAW:
            if not attrs.rstrip().endswith("/"):
                e = _END[tag].search(page, end)
                at = jump = e.end() if e else len(page)
        else:
            if tag in CLOSES_P and open_of.get("p"):
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in _ENDS_P), -1)
                if k >= 0 and stack[k].tag == "p":
                    pop_to(k)
            same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            if tag in SAME_LEVEL and any(open_of.get(x) for x in same):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in SAME_LEVEL[tag]:
                        break
                    if stack[k].tag in same:
                        pop_to(k)
                        break
            if tag in BLOCKS:
                flush()
            if tag not in VOID:
                above = stack[-1] if stack else _ROOT
                region = above.region or tag in ("article", "main")
                own = _excluded(tag, attrs, above.region)
                # an article ends the doubt about what is around it
                state = own if tag in ("article", "main") and above.state < 2 else max(above.state, own)
                named = above.named
                if state == 2 and not named:
                    named_elements += 1
                    named = named_elements
                path = numbers.setdefault((above.path, tag), len(numbers) + 1) if tag in BLOCKS else above.path
                whole = above.whole
                if tag in WHOLE and above.region and not whole:
                    wholes += 1
                    whole = wholes
                stack.append(_Open(tag, state, region, path, named, whole))
                open_of[tag] = open_of.get(tag, 0) + 1
        found = next(tags, None) if jump is None else (tags.send(jump), next(tags, None))[1]
    data(page[at:])
    flush()
    return out


def _smooth(values: list[float]) -> list[float]:
    weights = [math.exp(-k * k / 2) for k in range(RADIUS + 1)]
    out = []
    for i in range(len(values)):
        span = range(max(0, i - RADIUS), min(len(values), i + RADIUS + 1))
        total = sum(weights[abs(i - j)] for j in span)
        out.append(sum(values[j] * weights[abs(i - j)] for j in span) / total)
    return out


def _chars(some: list[Block]) -> int:
    return sum(len(b.text) for b in some)


def candidates(every: list[Block]) -> tuple[list[Block], bool]:
    """The blocks that compete, and whether a marked region holds them.

    Blocks under an excluding class are out, unless one such element has over half
    of the page's text and no marked region lies outside. A region that holds less than half of the text (teasers)
    does not keep the rest from competing."""
    whole, under = _chars(every), {}
    for b in every:
        under[b.named] = under.get(b.named, 0) + len(b.text)
    clear = any(b.region and not b.named for b in every)
    found = [b for b in every if not b.named or not clear and 2 * under[b.named] > whole]
    inside = [b for b in found if b.region]
    marked = bool(inside) and 2 * _chars(inside) >= _chars([b for b in found if not b.doubtful or b.region])
    return (inside, True) if marked else (found, False)


def path_scores(found: list[Block], marked: bool) -> dict[int, float]:
    """The fused score of each path."""
    paths: dict[int, list[float]] = {}
    for b in found:
        p = paths.setdefault(b.path, [0, 0, 0])
        p[0] += 1
        p[1] += len(b.text)
        p[2] += len(_PUNCT.findall(b.text))
    ratios = [[paths[b.path][k] / paths[b.path][0] for b in found] for k in (1, 2)]
    length, marks = ratios if marked else map(_smooth, ratios)
    score: dict[int, float] = {}
    for b, x, y in zip(found, length, marks):
        score[b.path] = score.get(b.path, 0.0) + x * (1 + y) * (DOUBT if b.doubtful else 1) / paths[b.path][0]
    return score


def wholes_kept(found: list[Block], mean: float) -> set[int]:
    """The numbers of the elements judged as a whole that are content: their length and
    punctuation, smoothed with those of the paths and elements beside them, reach the
    share, and most of their text is in no link. ``found`` is without the blocks of paths
    that fall short: an advert says nothing about the list beside it."""
    units: list[list[Block]] = []
    for b in found:
        if b.whole and units and units[-1][0].whole == b.whole:
            units[-1].append(b)
        else:
            units.append([b])
    size: dict[int, list[int]] = {}
    for b in found:
        if not b.whole:
            n = size.setdefault(b.path, [0, 0, 0])
            n[0], n[1], n[2] = n[0] + 1, n[1] + len(b.text), n[2] + len(_PUNCT.findall(b.text))
    own = [[size[u[0].path][k] / size[u[0].path][0] if not u[0].whole else sum(len(b.text) if k == 1 else len(_PUNCT.findall(b.text)) for b in u) for u in units] for k in (1, 2)]
    kept = set()
    for u, x, y in zip(units, *map(_smooth, own)):
        doubt = DOUBT if any(b.doubtful for b in u) else 1
        if u[0].whole and x * (1 + y) * doubt >= INSIDE * mean and sum(min(b.links, len(b.text)) for b in u) <= LINKS * _chars(u):
            kept.add(u[0].whole)
    return kept


def main_text(page: str | None) -> str:
    """The main text: content blocks joined by newlines; empty for null, empty
    or text-less pages. Headings inside a marked region stand with it, whatever
    their score; of several paths that all fall short none is taken."""
    found, marked = candidates(blocks(page or ""))
    if not found:
        return ""
    plain = [b for b in found if not (marked and b.whole)]
    if not plain:  # nothing but lists or tables: their paths compete
        for b in found:
            b.whole = 0
        plain = found
    score = path_scores(plain, marked)
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    for b in plain:
        size[b.path] = size.get(b.path, 0) + len(b.text)
        links[b.path] = links.get(b.path, 0) + min(b.links, len(b.text))
    mean = sum(score[k] * n for k, n in size.items()) / sum(size.values())
    share = INSIDE if marked else SHARE
    content = {k for k, n in size.items() if score[k] >= share * mean and links[k] <= LINKS * n}
    kept = wholes_kept([b for b in found if b.whole or b.path in content], mean) if len(plain) < len(found) else set()
    own = lambda b: marked and b.tag in HEADINGS and not b.doubtful and 2 * b.links <= len(b.text)
    return "\n".join(b.text for b in found if (b.whole in kept if marked and b.whole else b.path in content) or own(b))


def extract_text(page: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    return run(page)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with ``text``, its main text.

    Null, empty and text-less pages give the empty text; repeated rows stay
    repeated; an empty table gives an empty table; a column of ``pages`` named
    ``text`` is replaced. Rows are independent, so nothing is shuffled."""
    return with_columns(pages, {"text": extract_text(F.col(html_col))})

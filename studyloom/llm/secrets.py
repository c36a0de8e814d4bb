"""Secrets in texts, and how many owners and repositories each value has.

Candidates are found inside each row. Their hashes are counted over the whole
corpus by distinct owner and repository: a value that many owners carry is a
copied example, one that belongs to few owners and looks random is taken for
live. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.keys import mark_of, with_verdict
from studyloom.llm.storage import materialise, unpacked

# The patterns; letters of the keywords stand for either case.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYWORDS) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs are whole, so shorter ones can't hide longer ones
GENERIC = "[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "generic")
#: From so many distinct owners, or repositories of any owners, on, a value counts
#: as a copied example.
WIDE_OWNERS = 3
WIDE_REPOS = 5
#: Spans that are put in a row at once, so that lists are not copied for each span.
STRETCH = 256

_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches from the left whose ``group`` has ``least`` characters:
    the parts between the matches give their places."""
    parts = F.split(text, pattern, -1)
    whole, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(whole)).alias("p"), whole.alias("m"), inner.alias("g"))
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(x["p"])
        b = a + F.char_length(x["m"])
        span = F.struct(a.alias("start"), b.alias("end"), F.lit(kind).alias("kind"), x["g"].alias("value"))
        return F.struct(b.alias("at"), F.when(F.char_length(x["g"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def stretch(acc: Column, part: Column) -> Column:
        start = F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("out"))
        return F.concat(acc, F.array(F.aggregate(part, start, step)))

    first = F.array(F.struct(F.lit(0).alias("at"), none.alias("out")))
    return F.aggregate(_stretches(pairs), first, stretch, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))


def _stretches(a: Column) -> Column:
    """Parts of an array of STRETCH items each; an empty array has one empty part."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(STRETCH)), lambda i: F.slice(a, i, STRETCH))


def candidates(text: Column) -> Column:
    """All candidate spans of a text by start, then kind: array<struct<start, end,
    kind (place in KINDS), value>>; places count code points, ends are exclusive."""
    none = F.array().cast(_SPAN)
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), _matches(text, ASSIGN, 0, 2, 6)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, 1, 0, 20)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _matches(text, HEX, 2)).otherwise(none)
    generic = F.when(text.rlike(GENERIC), _matches(text, GENERIC, 3)).otherwise(none)
    mixed = F.filter(generic, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"))
    return F.array_sort(F.concat(assign, access, hexes, mixed))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(doc_id, mark, owner, repo, found) of the rows that have candidates; ``mark``
    is a hash of the text, so rows that share an id stay apart unless they are equal."""
    t = F.col(text)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), mark_of(t).alias("mark"),
        (owner if owner is not None else F.col("source")).cast("string").alias("owner"),
        (repository if repository is not None else F.concat_ws("/", F.col("source"), F.col("lang"))).cast("string").alias("repo"),
        candidates(F.coalesce(t, F.lit(""))).alias("found"),
    )
    return rows.where(F.size("found") > 0)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_docs, n_owners, n_repos) of every candidate value. Rows are reduced
    to one per value, owner and repository before values meet; a null owner counts
    as one owner."""
    each = found.select("owner", "repo", F.explode("found").alias("x")).select("owner", "repo", F.sha2(F.col("x.value"), 256).alias("hash"))
    less = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    less = less.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return less.groupBy("hash").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def _live(x: Column) -> Column:
    """Looks random: ten different characters or more and a digit."""
    return (F.size(F.array_distinct(F.split(x, ""))) >= 10) & x.rlike("[0-9]")


def judged(found: DataFrame) -> DataFrame:
    """(doc_id, mark, spans) with spans array<struct<start, end, kind, live>>: base
    kinds always, generic ones if they look live, belong to few owners and don't
    overlap a base span."""
    rows = found.dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", F.explode("found").alias("x"))
    rows = rows.select("doc_id", "mark", "x.*", F.sha2(F.col("x.value"), 256).alias("hash"), _live(F.col("x.value")).alias("random"))
    few = ownership(found).select("hash", ((F.col("n_owners") < WIDE_OWNERS) & (F.col("n_repos") < WIDE_REPOS)).alias("few"))
    marked = rows.join(few, "hash").withColumn("live", F.col("few") & F.col("random")).where((F.col("kind") < 3) | F.col("live"))
    spans = marked.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "live"))).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < 3)
    clear = lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    kept = F.filter("s", lambda x: (x["kind"] < 3) | clear(x))
    return spans.select("doc_id", "mark", F.array_sort(kept, _by_start).alias("spans"))


def _by_start(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["start"], x["kind"], x["end"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with ``spans``: array<struct<start, end, kind, live>>
    by start, then kind (0 assign, 1 access, 2 hex, 3 generic).

    ``live`` is true for values that look random and that fewer than WIDE_OWNERS
    owners and WIDE_REPOS repositories have. Null text counts as empty and has no
    spans; equal rows get equal spans; an empty table gives an empty table; a column
    of ``docs`` named ``spans`` is replaced. Candidates and verdicts are written to
    the shared folder; only texts with candidates are dealt out."""
    found = materialise(scan(docs, id_col, text, owner, repository), "secrets")
    verdicts = materialise(judged(found), "spans")
    kind = "array<struct<start:int,end:int,kind:int,live:boolean>>"
    joined = with_verdict(docs, verdicts, "spans", kind, id_col, mark_of(F.col(text)))
    return joined.select(*unpacked(docs.columns, "spans"), F.coalesce("verdict", F.array().cast(kind)).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``.

    Spans are taken in stretches, and each stretch looks at its own part of the
    text only, so the cost does not grow with the square of the spans."""

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.substring(acc["body"], acc["at"] - acc["base"] + 1, x["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["base"].alias("base"), acc["body"].alias("body"), out.alias("out"))

    def stretch(acc: Column, part: Column) -> Column:
        at = F.element_at(acc, -1)["at"]
        end = F.greatest(at, F.array_max(F.transform(part, lambda x: x["end"])))
        start = F.struct(at.alias("at"), at.alias("base"), F.substring(text, at + 1, end - at).alias("body"), F.lit("").alias("out"))
        done = lambda x: F.struct(x["at"].alias("at"), x["out"].alias("out"))
        return F.concat(acc, F.array(F.aggregate(part, start, step, done)))

    first = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("out")))
    rest = lambda acc: F.concat(F.array_join(F.transform(acc, lambda x: x["out"]), ""), F.substring(text, F.element_at(acc, -1)["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(_stretches(spans), first, stretch, rest)).otherwise(text)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

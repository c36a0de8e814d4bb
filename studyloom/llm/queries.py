"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items, and which items."""
    from studyloom.llm.decontam import hits

    found = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM items WHERE len(w) > 0)
), starts AS (
  SELECT r, s, size, list_slice(w, s, s + size - 1) AS g
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM words, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)
), found AS (
  SELECT r, s, starts.size AS size, item_id FROM starts JOIN wins ON starts.g = wins.g
), n_hit AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(s, s + size - 1)) AS p FROM (SELECT DISTINCT r, s, size FROM found)) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN n_hit USING (r) LEFT JOIN its USING (r)
"""


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the context-tree model, and its code
    length in bits a byte (the end byte counts)."""
    from studyloom.llm.ctw import score_documents

    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), held)
    return scored.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes"))


def op3_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    from studyloom.llm.trie_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model")).drop("text")


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from studyloom.llm.rules import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held)
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from studyloom.llm.html_paths import extract_pages

    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids of every document and of the text they decode to."""
    from studyloom.llm.pieces import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_documents(docs, tokenizer("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the least id of its component."""
    from studyloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids of every document, read back from the files."""
    from studyloom.llm.id_files import read_id_files, write_id_files

    path = write_id_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return read_id_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    from studyloom.llm.quality import rated

    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rated(table(spark, sf_dir, "documents")).select("doc_id", *[F.col(f"stats.{f}").alias(f) for f in fields], "base_failed", "kept")


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    from studyloom.llm import secrets as S

    found = S.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(S.span_text(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        S.span_text(F.col("spans")).alias("spans"),
    )


def _op9_sql() -> str:
    from studyloom.llm.secrets import ACCESS, ASSIGN, GENERIC, HEX, WIDE_OWNERS, WIDE_REPOS

    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [(0, "assign", ASSIGN, 2, 6), (1, "access", ACCESS, 0, 20), (2, "hex", HEX, 0, 24), (3, "generic", GENERIC, 0, 24)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, source, lang, {k} AS kind, '{name}' AS name, p, m, {least} AS least, regexp_extract_all(t, {quoted(p)}, {g}) AS g FROM (SELECT doc_id, source, lang, t, string_split_regex(t, {quoted(p)}) AS p, regexp_extract_all(t, {quoted(p)}) AS m FROM d WHERE regexp_matches(t, {quoted(p)}))"
        for k, name, p, g, least in kinds
    )
    return f"""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents), f AS ({found}),
    e AS (SELECT doc_id, source, lang, kind, name, least, unnest(generate_series(1, len(m))) AS i, p, m, g FROM f),
    s AS (SELECT doc_id, source, lang, kind, name, g[i] AS value, least,
      CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a,
      CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS b FROM e),
    c AS (SELECT * FROM s WHERE length(value) >= least AND (kind < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')))),
    o AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT coalesce(source, '') || '|' || concat_ws('/', source, lang)) AS repos FROM c GROUP BY value),
    k AS (SELECT c.* FROM c JOIN o USING (value) WHERE kind < 3 OR (owners < {WIDE_OWNERS} AND repos < {WIDE_REPOS} AND len(list_distinct(string_split(value, ''))) >= 10
      AND NOT EXISTS (SELECT 1 FROM c x WHERE x.doc_id = c.doc_id AND x.kind < 3 AND x.a < c.b AND c.a < x.b))),
    r AS (SELECT doc_id, count_if(kind = 0) AS n0, count_if(kind = 1) AS n1, count_if(kind = 2) AS n2, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans,
      string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 3) AS base FROM k GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (doc_id)"""


def _op10_sql() -> str:
    from studyloom.llm import quality as Q

    measures = "[" + ", ".join(f"{{'m': '{m}', 'v': {m}, 'slack': {Q.SLACK[m]}}}" for m in Q.SLACK) + "]"
    levels = " UNION ALL ".join(f"SELECT {k} AS level, {lang} AS lang, {source} AS source, m, slack, bin, count(*) AS n FROM cells GROUP BY ALL" for k, lang, source in ((2, "lang", "source"), (1, "lang", "NULL"), (0, "NULL", "NULL")))
    at = lambda q: f"min(bin) FILTER (upto >= floor((total - 1) * {q}) + 1)"
    value = lambda b: f"CASE WHEN {b} > {Q.ZERO_BIN} THEN 2 * pow({Q.GAMMA!r}, {b}) / ({Q.GAMMA!r} + 1) ELSE 0 END"
    blank = r"[^\x20\x09-\x0D]"
    return rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '{blank}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{blank}')) AS l FROM d),
    grams AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
    often AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
    rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN often USING (doc_id, g)) GROUP BY doc_id),
    s AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low FROM w LEFT JOIN rep USING (doc_id)),
    r AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_rate, CASE WHEN up + low > 0 THEN up / (up + low) ELSE 0 END AS upper_rate, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_rate FROM s),
    x AS (SELECT doc_id, lang, source, unnest({measures}, recursive := true) FROM r),
    cells AS (SELECT lang, source, m, slack, CASE WHEN v > {Q.LEAST} THEN CAST(ceil(ln(v) / {math.log(Q.GAMMA)!r}) AS INTEGER) ELSE {Q.ZERO_BIN} END AS bin FROM x),
    lv AS ({levels}), cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY level, lang, source, m) AS total FROM lv),
    q AS (SELECT level, lang, source, m, slack, total, {at(0.1)} AS lo, {at(0.5)} AS mid FROM cum GROUP BY level, lang, source, m, slack, total),
    lim AS (SELECT level, lang, source, m, total, {value("mid")} + {Q.SPREADS} * greatest({value("mid")} - {value("lo")}, slack) AS most FROM q),
    up AS (SELECT o.lang, o.source, o.m, o.total, o.most, CASE WHEN l.total >= {Q.MIN_DOCS} THEN l.most ELSE g.most END AS above FROM lim o JOIN lim l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.m = o.m JOIN lim g ON g.level = 0 AND g.m = o.m WHERE o.level = 2),
    bad AS (SELECT DISTINCT x.doc_id FROM x JOIN up ON up.lang IS NOT DISTINCT FROM x.lang AND up.source IS NOT DISTINCT FROM x.source AND up.m = x.m WHERE x.v > least(CASE WHEN up.total >= {Q.MIN_DOCS} THEN up.most ELSE up.above END, {Q.PARENT} * up.above))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {100 * Q.MAX_REPEAT:.0f} * n_words) AS base_failed,
      NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {100 * Q.MAX_REPEAT:.0f} * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM r"""


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, edits and digest of the repaired rows of every damaged conversation."""
    from studyloom.llm import turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    verdicts, repaired = turns.repair(turns.damaged(rows))
    sums = turns.digests(repaired).withColumnRenamed("conv_id", "of")
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    found = every.join(verdicts, every["id"].eqNullSafe(verdicts["conv_id"]), "left")
    found = found.join(sums, found["id"].eqNullSafe(sums["of"]), "left")
    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in fields],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _op11_sql() -> str:
    blank = r"[^\x20\x09-\x0D]"
    insert = lambda w, done: f"{{'c': {w}.c + 5, 's': {w}.s || 'I', 't': {w}.t || '{done}' || chr(58) || chr(10)}}"
    delete = lambda w: f"{{'c': {w}.c + 2, 's': {w}.s || 'D', 't': {w}.t}}"
    far = "{'c': 1000000000, 's': '', 't': ''}"
    keep = lambda w, r: f"CASE WHEN NOT bad AND initial = '{r}' THEN {{'c': {w}.c + open, 's': {w}.s || 'K', 't': {w}.t || role || chr(58) || text || chr(10)}} ELSE {far} END"
    rerole = lambda w, r: f"CASE WHEN NOT bad THEN {{'c': {w}.c + 1 + open, 's': {w}.s || 'R', 't': {w}.t || '{r}' || chr(58) || text || chr(10)}} ELSE {far} END"
    inserted = lambda source: f"SELECT * REPLACE (list_min([w3, {insert('w2', 'assistant')}]) AS w3) FROM (SELECT * REPLACE (list_min([w2, {insert('w0', 'user')}, {insert('w1', 'user')}, {insert('w3', 'user')}]) AS w2) FROM {source})"
    after = f"""SELECT conv, i + 1 AS i, {delete('w0')} AS w0, list_min([{delete('w1')}, {keep('w0', 's')}]) AS w1,
      list_min([{delete('w2')}, {', '.join(f(w, r) for w in ('w0', 'w1', 'w3') for f, r in ((keep, 'u'), (rerole, 'user')))}]) AS w2,
      list_min([{delete('w3')}, {keep('w2', 'a')}, {rerole('w2', 'assistant')}]) AS w3"""
    step = "lambda n: CASE WHEN n & 1 = 1 THEN xor(n >> 1, CAST(3988292384 AS UBIGINT)) ELSE n >> 1 END"
    table_ = "list_transform(range(256), lambda n: CAST(n AS UBIGINT))"
    for _ in range(8):
        table_ = f"list_transform({table_}, {step})"
    return rf"""WITH RECURSIVE crc AS (SELECT {table_} AS t),
    o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    k AS (SELECT o.*, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 20 AS kind FROM o, crc),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
    ids AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
    f AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, left(text, 32), text) AS i,
      left(role, 1) AS initial, NOT regexp_matches(text, '{blank}') AS blank, regexp_extract(text, '({blank})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut FROM d JOIN ids ON ids.conv_id IS NOT DISTINCT FROM d.conv_id),
    g AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again FROM f),
    r AS (SELECT *, blank OR again AS bad, CASE WHEN cut THEN 5 ELSE 0 END AS open, initial || lead(initial) OVER (PARTITION BY conv ORDER BY i) AS pair FROM g),
    p AS (SELECT conv, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 's': '', 't': ''}} AS w0, {{'c': CAST(1000000000 AS BIGINT), 's': '', 't': ''}} AS w1, {{'c': CAST(1000000000 AS BIGINT), 's': '', 't': ''}} AS w2, {{'c': CAST(1000000000 AS BIGINT), 's': '', 't': ''}} AS w3 FROM (SELECT DISTINCT conv FROM r)
      UNION ALL {after} FROM (SELECT z.*, r.role, r.text, r.initial, r.bad, r.open FROM ({inserted('p')}) z JOIN r ON r.conv = z.conv AND r.i = z.i + 1)),
    e AS (SELECT conv, list_min([w0, w3]) AS w FROM ({inserted('(SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1)')})),
    c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(cut AND NOT bad) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv)
    SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
      CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.s, '') AS audit, sha256(CASE WHEN w.t IS NULL OR w.t = '' THEN '' ELSE left(w.t, length(w.t) - 1) END) AS repaired_sha256 FROM ids LEFT JOIN e USING (conv) LEFT JOIN c USING (conv)"""


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those removed as repeats, and a digest of the rest."""
    from studyloom.llm.repeats import cut_repeats

    cut = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select("row.doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def _op12_sql() -> str:
    from studyloom.llm.repeats import WINDOW

    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT r, id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT r, id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})),
    m AS (SELECT h, min(id) AS least FROM g GROUP BY h HAVING min(id) < max(id)),
    gone AS (SELECT r, list(DISTINCT p) AS p FROM (SELECT r, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM g JOIN m USING (h) WHERE id > least) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
      sha256(CASE WHEN p IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda x: NOT list_contains(p, x)), lambda i: w[i]), ' ') END) AS kept_sha256 FROM d LEFT JOIN gone USING (r)"""


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    from studyloom.llm.ranked import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT r, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, * FROM benchmark)),
s AS (SELECT count_if(len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
p AS (SELECT r, doc_id, len(w) AS size, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM s) + 2.0::DOUBLE) / (2 * count(*) + 1.0::DOUBLE))) AS BIGINT) AS wt FROM p GROUP BY term),
x AS (SELECT q.r AS item, item_id, p.r, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * s.n) // s.l)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN t USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 50
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op2_ctw": op2_ctw, "op3_trie_counts": op3_trie_counts, "op4_rule_ensemble": op4_rule_ensemble, "op5_html_paths": op5_html_paths, "op6_pieces": op6_pieces, "op7_simhash": op7_simhash, "op8_id_files": op8_id_files, "op9_secret_ownership": op9_secret_ownership, "op10_quality_rules": op10_quality_rules, "op11_turns": op11_turns, "op12_repeats": op12_repeats, "op13_ranked": op13_ranked, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op9_secret_ownership": _op9_sql(), "op10_quality_rules": _op10_sql(), "op11_turns": _op11_sql(), "op12_repeats": _op12_sql(), "op13_ranked": OP13_SQL}

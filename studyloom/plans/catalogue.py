"""The registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions import coords, html, text
from studyloom.functions import status as st
from studyloom.operators import annotation, cbma, export, relational, report, retrieval, screening
from studyloom.plans import records, views  # noqa: F401 (records registers its queries)
from studyloom.plans.registry import QUERIES, SQL, Query, query
from studyloom.plans.views import table

def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- counts over studies


@query(
    """SELECT count(*) AS total_identified, count_if(status <> 'pending')::BIGINT AS abstract_screened, count_if(status = 'excluded_abstract')::BIGINT AS abstract_excluded,
    count_if(status IN ('included_fulltext', 'excluded_fulltext', 'fulltext_incomplete'))::BIGINT AS fulltext_assessed, count_if(status = 'excluded_fulltext')::BIGINT AS fulltext_excluded,
    count_if(status = 'fulltext_incomplete')::BIGINT AS fulltext_incomplete, count_if(status = 'included_fulltext')::BIGINT AS final_included FROM v_studies""",
    "v_studies",
)
def prisma_counts(spark, sf_dir):
    return report.prisma_counts(views.screened(spark, sf_dir))


@query(
    """SELECT count(*) AS found, count_if(status <> 'pending')::BIGINT AS abstract_screened, count_if(status IN ('included_abstract', 'included_fulltext', 'excluded_fulltext', 'fulltext_incomplete'))::BIGINT AS included_after_abstract,
    count_if(status = 'excluded_abstract')::BIGINT AS excluded_at_abstract, count_if(status IN ('included_fulltext', 'excluded_fulltext', 'fulltext_incomplete'))::BIGINT AS fulltext_screened,
    count_if(status = 'fulltext_incomplete')::BIGINT AS fulltext_incomplete, count_if(status = 'included_fulltext')::BIGINT AS included FROM v_studies""",
    "v_studies",
)
def cli_summary_counts(spark, sf_dir):
    return report.summary_counts(views.screened(spark, sf_dir))


@query(
    """SELECT count(*) AS total_studies, count_if(status = 'included_fulltext')::BIGINT AS included_studies, count_if(status IN ('excluded_abstract', 'excluded_fulltext'))::BIGINT AS excluded_studies,
    count_if(status = 'pending')::BIGINT AS pending_studies FROM v_studies""",
    "v_studies",
)
def run_statistics(spark, sf_dir):
    return report.run_statistics(views.screened(spark, sf_dir))


@query(
    """SELECT count_if(NOT incomplete AND decision = 'INCLUDED')::BIGINT AS included, count_if(NOT incomplete AND decision = 'EXCLUDED')::BIGINT AS excluded, count_if(incomplete)::BIGINT AS incomplete, 0::BIGINT AS failed FROM v_resp""",
    "v_resp",
)
def screening_tally(spark, sf_dir):
    return screening.tally(screening.process_responses(views.responses(spark, sf_dir), "fulltext"))


@query("SELECT status, count(*) AS n FROM v_studies GROUP BY ROLLUP (status)", "v_studies")
def status_rollup(spark, sf_dir):
    return views.screened(spark, sf_dir).rollup("status").agg(F.count("*").alias("n"))


# --- screening


@query("SELECT study_id, CASE WHEN confidence < 0.2 OR decision = 'EXCLUDED' THEN 'excluded_abstract' ELSE 'included_abstract' END AS decision, confidence < 0.2 AS turned FROM v_resp", "v_resp")
def abstract_threshold(spark, sf_dir):
    rows = views.responses(spark, sf_dir).withColumn("turned", st.below_threshold(F.col("confidence"), True, 0.2))
    return screening.process_responses(rows, "abstract", True, 0.2).select("study_id", "decision", "turned")


@query("SELECT study_id, CASE WHEN confidence < 0.2 THEN printf('Confidence %.2f below threshold 0.2. because', confidence) ELSE 'because' END AS reason FROM v_resp", "v_resp")
def threshold_reason(spark, sf_dir):
    return screening.process_responses(views.responses(spark, sf_dir), "abstract", True, 0.2).select("study_id", "reason")


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')")
def pending_with_abstract(spark, sf_dir):
    return screening.with_abstract(screening.pending(views.studies(spark, sf_dir))).select("pmid")


@query("SELECT pmid FROM v_studies WHERE (fulltext_available OR full_text_path <> '' OR pmcid IS NOT NULL) AND abstract_status = 'included_abstract' AND status = 'included_abstract'", "v_studies")
def fulltext_screenable(spark, sf_dir):
    return screening.screenable(views.screened(spark, sf_dir), "fulltext").select("pmid")


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_ids_anti(spark, sf_dir):
    cached = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("pmid"))
    return relational.new_ids(views.studies(spark, sf_dir).select("pmid"), cached)


CACHE = "CASE WHEN doc_id % 5 = 0 THEN ' Included ' WHEN doc_id % 5 = 1 THEN 'excluded_abstract' WHEN doc_id % 5 = 2 THEN 'fulltext_incomplete' WHEN doc_id % 5 = 3 THEN 'nonsense' ELSE 'screening_failed' END"


@query(
    f"""SELECT CAST(d.doc_id AS VARCHAR) AS pmid, CASE WHEN l.doc_id % 5 = 0 THEN 'included_fulltext' WHEN l.doc_id % 5 = 1 THEN 'excluded_fulltext' WHEN l.doc_id % 5 = 4 THEN 'screening_failed' END AS cached_status
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def cache_split(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("study_id"), F.expr(CACHE).alias("decision"), F.lit("r").alias("reason"), F.lit(1.0).alias("confidence"))
    cached, todo = screening.cache_split(views.studies(spark, sf_dir).select("pmid"), stored, "fulltext", force_incomplete=True)
    return cached.select("pmid", "cached_status").unionByName(todo.select("pmid", F.lit(None).cast("string").alias("cached_status")))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'included_abstract' WHEN 1 THEN 'excluded_abstract' WHEN 2 THEN 'included_abstract' WHEN 3 THEN 'included_fulltext' WHEN 4 THEN NULL ELSE 'pending' END AS status FROM labels"""
)
def status_normalise(spark, sf_dir):
    raw = F.expr("CASE doc_id % 6 WHEN 0 THEN ' INCLUDED' WHEN 1 THEN 'Excluded\n' WHEN 2 THEN 'fulltext_retrieved' WHEN 3 THEN 'INCLUDED_FULLTEXT' WHEN 4 THEN 'what' ELSE 'pending' END")
    return table(spark, sf_dir, "labels").select("doc_id", st.normalised(raw).alias("status"))


@query("SELECT pmid, CASE WHEN abstract_status = 'pending' THEN 'included_fulltext' WHEN status = 'included_abstract' THEN 'included_fulltext' ELSE status END AS status FROM v_studies", "v_studies")
def skip_stage_promotion(spark, sf_dir):
    rows = screening.skip_stage(views.screened(spark, sf_dir), "abstract")
    return screening.skip_stage(rows, "fulltext").select("pmid", "status")


@query(
    """SELECT CAST(d.doc_id AS VARCHAR) AS pmid, coalesce(CASE WHEN r.incomplete THEN 'fulltext_incomplete' WHEN r.decision = 'INCLUDED' THEN 'included_fulltext' WHEN r.decision = 'EXCLUDED' THEN 'excluded_fulltext' END, 'screening_failed') AS decision
    FROM documents d LEFT JOIN v_resp r ON r.study_id = CAST(d.doc_id AS VARCHAR)""",
    "v_resp",
)
def model_screen_replay(spark, sf_dir):
    from studyloom.operators.models import ReplayClient, screen

    answers = views.responses(spark, sf_dir)
    payload = F.to_json(F.struct("decision", "confidence", "reason", "fulltext_incomplete"))
    client = ReplayClient(answers.select(F.lit("fulltext").alias("task"), "study_id", F.lit(None).cast("string").alias("item_id"), F.lit(1).alias("attempt"), payload.alias("payload")))
    return screen(views.studies(spark, sf_dir).select("pmid"), client, "fulltext").select(F.col("study_id").alias("pmid"), "decision")


# --- retrieval


@query("SELECT pmid, CAST(pmid AS BIGINT) AS pmid_number, retrieval_in_scope, in_included_set FROM v_studies", "v_studies")
def retrieval_scope(spark, sf_dir):
    rows = views.screened(spark, sf_dir)
    return rows.join(retrieval.number_pmids(rows), "pmid").select("pmid", "pmid_number", "retrieval_in_scope", "in_included_set")


@query(
    """SELECT CAST(d.doc_id AS VARCHAR) AS pmid, CASE WHEN p.page_id IS NOT NULL THEN 0 WHEN b.item_id IS NOT NULL THEN 1 END AS source_pos, coalesce(p.url, CASE WHEN b.item_id IS NOT NULL THEN 'benchmark' END) AS path
    FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id"""
)
def first_source_wins(spark, sf_dir):
    one = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("pmid"), F.col("url").alias("path"))
    two = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("pmid"), F.lit("benchmark").alias("path"))
    return relational.first_source(views.studies(spark, sf_dir).select("pmid"), [one, two], "pmid").select("pmid", "source_pos", "path")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS pmid, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id + 1000000 END, b.item_id + 500) AS pmcid FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def pmcid_lookup(spark, sf_dir):
    found = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("pmid"), text.pmcid_number(F.concat(F.lit("PMC"), (F.col("item_id") + 500).cast("string"))).alias("pmcid"))
    return relational.lookup(views.studies(spark, sf_dir).select("pmid", "pmcid"), found, "pmid", "pmcid")


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 3 = 0 THEN coalesce(doc_id IN (SELECT page_id * 3 FROM pages), false) ELSE false END AS fulltext_available FROM documents")
def retrieved_flag(spark, sf_dir):
    rows = views.studies(spark, sf_dir).select("pmid", "pmcid", F.lit(None).cast("boolean").alias("fulltext_available"), F.lit(None).cast("string").alias("full_text_source"))
    got = table(spark, sf_dir, "pages").select((F.col("page_id") * 3 + 1_000_000).alias("pmcid"))
    return retrieval.mark_retrieved(rows, got).select("pmid", "fulltext_available")


@query(
    """SELECT pmid, CASE WHEN status = 'fulltext_incomplete' THEN 'incomplete' ELSE 'unavailable' END AS type, CASE WHEN fulltext_available THEN 'local' ELSE '' END AS source,
    coalesce(full_text_path, CASE WHEN status = 'fulltext_incomplete' AND pmcid IS NOT NULL THEN 'out/retrieval/pubget_data/text.csv [pmcid=' || pmcid || ']' END, '') AS full_text_path,
    coalesce(in_included_set, status = 'included_abstract') AS in_included_set FROM v_studies WHERE status = 'fulltext_incomplete' OR (retrieval_in_scope AND NOT fulltext_available)""",
    "v_studies",
)
def missing_fulltexts(spark, sf_dir):
    return report.missing_fulltexts(views.screened(spark, sf_dir), "out")


@query("SELECT count_if(retrieval_in_scope)::BIGINT AS considered, count_if(fulltext_available)::BIGINT AS available, count_if(retrieval_in_scope AND NOT fulltext_available)::BIGINT AS missing FROM v_studies", "v_studies")
def retrieval_stats(spark, sf_dir):
    return retrieval.retrieval_stats(views.screened(spark, sf_dir))


@query("SELECT o_orderkey AS pmcid, 't' || CAST(o_orderkey % 3 AS VARCHAR) AS table_id, o_orderpriority AS table_caption FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 3 = o_orderkey % 3)")
def tables_with_coords(spark, sf_dir):
    tables = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pmcid"), F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string")).alias("table_id"), F.col("o_orderpriority").alias("table_caption"))
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pmcid"), F.concat(F.lit("t"), (F.col("l_linenumber") % 3).cast("string")).alias("table_id"))
    return retrieval.tables_with_coordinates(tables, points, "pmcid")


@query(
    """SELECT study, table_id, (row_number() OVER (PARTITION BY study ORDER BY table_id) - 1)::BIGINT AS analysis_pos, description, n, x0 FROM (SELECT study, table_id, arg_min(table_label, row_pos) AS description, count(*) AS n, arg_min(x, row_pos) AS x0 FROM v_foci WHERE study IS NOT NULL GROUP BY study, table_id)""",
    "v_foci",
)
def group_coordinates(spark, sf_dir):
    grouped = retrieval.group_coordinates(views.foci(spark, sf_dir), "study")
    return grouped.select("study", "table_id", F.col("analysis_pos").cast("long").alias("analysis_pos"), "description", F.size("points").cast("long").alias("n"), F.col("points")[0]["coordinates"][0].alias("x0"))


@query("SELECT s_suppkey AS pmcid, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM supplier")
def csv_merge(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pmcid"), F.col("s_name").alias("name"), F.lit("old").alias("version"))
    new = old.where("pmcid % 4 = 0").withColumn("version", F.lit("new"))
    return retrieval.merge_csv(old, new)


@query("SELECT doc_id AS pmcid, CASE doc_id % 3 WHEN 0 THEN 'MNI' ELSE 'TAL' END AS coordinate_space FROM documents WHERE doc_id % 3 < 2")
def known_spaces(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmcid"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'MNI' WHEN 1 THEN 'TAL' ELSE 'UNKNOWN' END").alias("coordinate_space"))
    return retrieval.known_space(rows)


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents UNION ALL SELECT CAST(item_id AS VARCHAR) FROM benchmark")
def union_ids(spark, sf_dir):
    return relational.union_ids([views.studies(spark, sf_dir).select(F.col("pmid").alias("id")), table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))])


@query("SELECT DISTINCT id FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents UNION ALL SELECT CAST(item_id AS VARCHAR) FROM benchmark)")
def union_ids_distinct(spark, sf_dir):
    return relational.union_ids([views.studies(spark, sf_dir).select(F.col("pmid").alias("id")), table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))], distinct=True)


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def id_set_filter(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("pmid"))
    return relational.in_ids(views.studies(spark, sf_dir).select("pmid"), ids, "pmid")


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::BIGINT AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def ranked_search(spark, sf_dir):
    """Top of a ranked search: the limit is the feature."""
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.select(F.col("o_orderkey").alias("id"), (F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1).cast("long").alias("rank"))


# --- analyses, coordinates


@query("SELECT row_pos, study || '_analysis_' || (row_number() OVER (PARTITION BY study ORDER BY row_pos) - 1) AS analysis_id FROM v_foci", "v_foci")
def analysis_ordinals(spark, sf_dir):
    return annotation.number_analyses(views.foci(spark, sf_dir), "study", "row_pos").select("row_pos", "analysis_id")


@query("SELECT row_pos, CAST(round_even(x, 0) AS INTEGER) AS x, CAST(round_even(y, 0) AS INTEGER) AS y, CAST(round_even(z / 2, 0) AS INTEGER) AS half FROM v_foci", "v_foci")
def coordinate_round(spark, sf_dir):
    return views.foci(spark, sf_dir).select("row_pos", coords.rounded(F.col("x")).alias("x"), coords.rounded(F.col("y")).alias("y"), coords.rounded(F.col("z") / 2).alias("half"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'MNI' WHEN 1 THEN 'TAL' ELSE CASE WHEN user_id % 2 = 0 THEN 'MNI' END END AS space FROM events")
def space_sanitise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    point = F.expr("CASE event_id % 4 WHEN 0 THEN 'MNI' WHEN 1 THEN 'TAL' WHEN 2 THEN 'mni' END")
    study = F.expr("CASE WHEN user_id % 2 = 0 THEN 'MNI' ELSE 'other' END")
    return e.select("event_id", coords.space(point, study).alias("space"))


@query("SELECT row_pos FROM v_foci WHERE isfinite(CASE WHEN row_pos % 10 = 0 THEN 'nan'::DOUBLE WHEN row_pos % 10 = 1 THEN 'inf'::DOUBLE WHEN row_pos % 10 = 2 THEN NULL ELSE x END)", "v_foci")
def finite_coords(spark, sf_dir):
    x = F.expr("CASE WHEN row_pos % 10 = 0 THEN double('nan') WHEN row_pos % 10 = 1 THEN double('infinity') WHEN row_pos % 10 = 2 THEN NULL ELSE x END")
    return views.foci(spark, sf_dir).where(coords.finite_point(F.array(x, "z", "z"))).select("row_pos")


@query("SELECT row_pos FROM v_foci WHERE row_pos % 3 <> 0 AND row_pos % 5 <> 0 AND y IS NOT NULL", "v_foci")
def valid_points(spark, sf_dir):
    point = F.when(F.col("row_pos") % 3 == 0, F.array("x", "y")).when(F.col("row_pos") % 5 == 0, F.array(F.col("x"), F.lit(None), F.col("y"))).otherwise(F.array("x", "y", "z"))
    return views.foci(spark, sf_dir).where(coords.valid_point(point)).select("row_pos")


@query("SELECT row_pos, CASE WHEN row_pos % 2 = 0 THEN CAST(row_pos AS VARCHAR) ELSE 'n.s.' END AS value_text, CASE WHEN row_pos % 2 = 0 THEN CAST(row_pos AS DOUBLE) END AS value_num, row_pos % 3 <> 0 AS known_kind FROM v_foci", "v_foci")
def point_values(spark, sf_dir):
    raw = F.expr("CASE WHEN row_pos % 2 = 0 THEN string(row_pos) ELSE 'n.s.' END")
    kind = F.expr("CASE row_pos % 3 WHEN 0 THEN 'z score' WHEN 1 THEN 't-statistic' END")
    return views.foci(spark, sf_dir).select("row_pos", coords.value(raw)["value_text"].alias("value_text"), coords.value(raw)["value_num"].alias("value_num"), coords.known_kind(kind).alias("known_kind"))


# --- scalar functions


@query("SELECT doc_id, nullif(regexp_replace(translate(split_part(text, chr(10), 1), '''\"', ''), '^\\s+|\\s+$', '', 'g'), '') AS name FROM documents")
def name_sanitise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.analysis_name(F.split_part("text", F.lit("\n"), F.lit(1))).alias("name"))


@query("SELECT p_partkey, coalesce(nullif(upper(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'ANNOTATION') AS namespace FROM part")
def criteria_namespace(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.criteria_namespace(F.col("p_name")).alias("namespace"))


@query("SELECT kind, text, CASE kind WHEN 'inclusion' THEN 'I' ELSE 'E' END || row_number() OVER (PARTITION BY kind ORDER BY stage, pos) AS id FROM (SELECT 'inclusion' AS kind, n_name AS text, n_regionkey AS stage, n_nationkey AS pos FROM nation UNION ALL SELECT 'exclusion', r_name, 0, r_regionkey FROM region)")
def criteria_ids(spark, sf_dir):
    """Ids run on over the stages, for inclusion and exclusion apart."""
    inc = table(spark, sf_dir, "nation").select(F.lit("inclusion").alias("kind"), F.col("n_name").alias("text"), F.col("n_regionkey").alias("stage"), F.col("n_nationkey").alias("pos"))
    exc = table(spark, sf_dir, "region").select(F.lit("exclusion").alias("kind"), F.col("r_name").alias("text"), F.lit(0).alias("stage"), F.col("r_regionkey").alias("pos"))
    number = F.row_number().over(Window.partitionBy("kind").orderBy("stage", "pos")).cast("string")
    return inc.union(exc).select("kind", "text", F.concat(F.when(F.col("kind") == "inclusion", "I").otherwise("E"), number).alias("id"))


@query("SELECT event_id, regexp_matches(CASE event_id % 4 WHEN 0 THEN 'I1' WHEN 1 THEN 'GLOBAL_E12' WHEN 2 THEN 'i3' ELSE 'X4' END, '^(?:[A-Z0-9_]+_)?[IE][0-9]+$') AS is_id FROM events")
def criteria_regex(spark, sf_dir):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN 'I1' WHEN 1 THEN 'GLOBAL_E12' WHEN 2 THEN 'i3' ELSE 'X4' END")
    return table(spark, sf_dir, "events").select("event_id", text.is_criteria_id(raw).alias("is_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders")
def year_extract(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy MMM dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.publication_year(raw).alias("year"))


@query("SELECT o_orderkey, trim(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(month(o_orderdate) AS VARCHAR) END || ' ' || CAST(day(o_orderdate) AS VARCHAR)) AS date FROM orders")
def pub_date_text(spark, sf_dir):
    d = F.col("o_orderdate")
    year, month = F.when(F.col("o_orderkey") % 5 != 0, F.year(d).cast("string")), F.when(F.col("o_orderkey") % 3 != 0, F.month(d).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.publication_date(year, month, F.day(d).cast("string")).alias("date"))


@query("SELECT c_nationkey, count(*) AS n, string_agg(CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment || ' ' || c_name END, ', ' ORDER BY c_custkey) AS authors FROM customer WHERE c_custkey % 3 <> 0 GROUP BY c_nationkey")
def author_join(spark, sf_dir):
    fore, last = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    people = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("k"), fore.alias("fore"), last.alias("last")))).alias("a"))
    names = text.author_names(F.col("a"))
    return people.select("c_nationkey", F.size(names).cast("long").alias("n"), text.joined(names).alias("authors"))


HTML_SQL = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in html.DROPPED:
    HTML_SQL = f"regexp_replace({HTML_SQL}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>|<{_tag}\\b[^>]*/?>', '', 'g')"
HTML_SQL = f"""regexp_replace({HTML_SQL}, '(?i)\\s(?:{"|".join(html.ATTRIBUTES)})\\s*=\\s*(?:"[^"]*"|''[^'']*'')', '', 'g')"""


@query(f"SELECT page_id, {HTML_SQL} AS html FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.cleaned(F.col("html")).alias("html"))


# Pieces from one opening tag to the next, each cut at its own closing tag.
_OPENED = f"""regexp_replace({HTML_SQL}, '(?is)<(p|h[1-6])(?:\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'g')"""
_PIECE = "regexp_replace(regexp_replace(substr(x, strpos(x, chr(2)) + 1), '(?is)</' || substr(x, 1, strpos(x, chr(2)) - 1) || '\\s*>.*', ''), '(?s)<[^>]*>', '', 'g')"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
    _PIECE = f"replace({_PIECE}, '&{_name};', '{_char}')"
_TEXT_SQL = f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_OPENED}, chr(1))[2:], lambda x: regexp_replace({_PIECE}, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), chr(10) || chr(10)) AS text FROM pages"


@query(_TEXT_SQL)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.paragraphs(F.col("html")).alias("text"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN true WHEN 'assistant' THEN false END AS flag FROM (SELECT conv_id, turn, role FROM conversations)")
def bool_coercion(spark, sf_dir):
    raw = F.when(F.col("role") == "user", F.when(F.col("turn") % 2 == 0, " Yes").otherwise("1")).when(F.col("role") == "assistant", F.when(F.col("turn") % 2 == 0, "FALSE").otherwise("no")).otherwise("maybe")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.boolean(raw).alias("flag"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN NULL ELSE n_name END AS caption FROM nation")
def nan_to_null(spark, sf_dir):
    raw = F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'NaN' ELSE n_name END")
    return table(spark, sf_dir, "nation").select("n_nationkey", text.not_nan(raw).alias("caption"))


@query("SELECT n_nationkey, list_aggregate(list_sort(map_keys(m)), 'string_agg', ',') AS keys, list_aggregate(list_transform(list_sort(map_keys(m)), lambda k: m[k]), 'string_agg', ',') AS vals FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN MAP {'a': 'global', 'b': n_name} ELSE MAP {'a': n_name, 'b': 'global'} END AS m FROM nation)")
def map_merge(spark, sf_dir):
    both = F.create_map(F.lit("a"), F.lit("global"), F.lit("b"), F.lit("global"))
    own = F.create_map(F.when(F.col("n_nationkey") % 2 == 0, "b").otherwise("a"), F.col("n_name"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", relational.merged_maps(own, both).alias("m"))
    keys = F.array_sort(F.map_keys("m"))
    return rows.select("n_nationkey", F.array_join(keys, ",").alias("keys"), F.array_join(F.transform(keys, lambda k: F.col("m")[k]), ",").alias("vals"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '.\\.[^.]*$') THEN regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') ELSE regexp_extract(url, '([^/]*)$', 1) END AS stem FROM pages")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.file_name(F.col("url")).alias("name"), text.stem(F.col("url")).alias("stem"))


# --- annotation


@query(
    """, upd AS (SELECT study_id, list(DISTINCT annotation_name) AS names, bool_or(annotation_name NOT IN ('all_studies', 'all_abstract', 'all_analyses')) AS custom FROM v_new GROUP BY study_id),
    kept AS (SELECT o.*, 0 AS is_new FROM v_old o LEFT JOIN upd u ON o.study_id = u.study_id WHERE u.study_id IS NULL OR NOT (list_contains(u.names, o.annotation_name) OR (u.custom AND o.annotation_name NOT IN ('all_studies', 'all_abstract', 'all_analyses')))),
    every AS (SELECT * FROM kept UNION ALL SELECT *, 1 FROM v_new)
    SELECT study_id, analysis_id, annotation_name, arg_max(include, is_new * 1000000000000 + pos) AS include, arg_max(pos, is_new * 1000000000000 + pos) AS pos FROM every GROUP BY ALL HAVING true""".replace("GROUP BY ALL HAVING true", "GROUP BY study_id, analysis_id, annotation_name"),
    "v_ann",
)
def annotation_upsert(spark, sf_dir):
    rows = _named(views.annotations(spark, sf_dir))
    fresh = F.expr("pos % 4 = 0 and study_id % 3 = 0")
    old, new = rows.where(~fresh), rows.where(fresh)
    return annotation.upsert(old, new).select(*annotation.KEY, "include", "pos")


def _named(rows: DataFrame) -> DataFrame:
    """Two of the names stand for system annotations."""
    return rows.withColumn("annotation_name", F.when(F.col("pos") % 5 == 0, "all_studies").when(F.col("pos") % 5 == 1, "all_abstract").otherwise(F.col("annotation_name")))


_named_sql = "SELECT study_id, analysis_id, CASE WHEN pos % 5 = 0 THEN 'all_studies' WHEN pos % 5 = 1 THEN 'all_abstract' ELSE annotation_name END AS annotation_name, include, pos FROM v_ann"
SQL["annotation_upsert"] = SQL["annotation_upsert"].replace(" , upd AS", f", v_old AS ({_named_sql} WHERE NOT (pos % 4 = 0 AND CAST(study_id AS BIGINT) % 3 = 0)), v_new AS ({_named_sql} WHERE pos % 4 = 0 AND CAST(study_id AS BIGINT) % 3 = 0), upd AS")


@query(
    """SELECT d.study_id, d.annotation_name, d.n, coalesce(a.need, 0)::BIGINT AS need, coalesce(d.n = a.need, false) AS complete FROM (SELECT study_id, annotation_name, count(*) AS n FROM v_ann GROUP BY study_id, annotation_name) d
    LEFT JOIN (SELECT study_id, count(DISTINCT analysis_id) AS need FROM v_ann GROUP BY study_id) a USING (study_id)""",
    "v_ann",
)
def annotation_completeness(spark, sf_dir):
    return annotation.complete(views.annotations(spark, sf_dir), views.analyses(spark, sf_dir))


NAMES = ("click", "view", "purchase", "absent")


@query(
    "SELECT analysis_id, " + ", ".join(f"coalesce(arg_max(include, pos) FILTER (annotation_name = '{n}'), false) AS \"{n}\"" for n in NAMES) + " FROM v_ann GROUP BY analysis_id", "v_ann"
)
def annotation_pivot(spark, sf_dir):
    return annotation.notes(views.annotations(spark, sf_dir), views.analyses(spark, sf_dir), list(NAMES))


@query(
    """SELECT pmid AS study_id, pmid || '_analysis_0' AS analysis_id, scope AS annotation_name, true AS include FROM v_studies, (VALUES ('all_studies'), ('all_abstract'), ('all_analyses')) s(scope)
    WHERE scope = 'all_studies' OR (scope = 'all_abstract' AND status <> 'excluded_abstract') OR (scope = 'all_analyses' AND status = 'included_fulltext')""",
    "v_studies",
)
def system_annotations(spark, sf_dir):
    rows = views.screened(spark, sf_dir).select("pmid", "status", F.concat("pmid", F.lit("_analysis_0")).alias("analysis_id"))
    return annotation.system_decisions(rows).select("study_id", "analysis_id", "annotation_name", "include")


@query("SELECT study_id, analysis_id, pos FROM v_ann WHERE CAST(study_id AS BIGINT) NOT IN (SELECT item_id FROM benchmark) OR analysis_id NOT LIKE '%_0'", "v_ann")
def hallucinated_ids(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("study_id"), F.concat(F.col("item_id").cast("string"), F.lit("_analysis_0")).alias("analysis_id"))
    return annotation.hallucinated(views.annotations(spark, sf_dir), known).select("study_id", "analysis_id", "pos")


@query(
    """SELECT study_id, analysis_id, array_to_string(list_sort(list_filter(['absent', 'click', 'view'], lambda x: NOT list_contains(l, x))), ',') AS missing,
    array_to_string(list_sort(list_filter(list_distinct(l), lambda x: x NOT IN ('absent', 'click', 'view'))), ',') AS extra, len(l) <> len(list_distinct(l)) AS duplicates FROM (SELECT study_id, analysis_id, list(annotation_name) AS l FROM v_ann GROUP BY study_id, analysis_id)""",
    "v_ann",
)
def coverage_check(spark, sf_dir):
    rows = annotation.coverage(views.annotations(spark, sf_dir), ["absent", "click", "view"])
    return rows.withColumns({"missing": F.array_join("missing", ","), "extra": F.array_join("extra", ",")})


@query(
    """SELECT study_id, analysis_id, pos, CASE WHEN annotation_name IS DISTINCT FROM 'click' THEN NULL WHEN include AND pos % 3 = 0 THEN 'inclusion without an id' WHEN pos % 3 = 1 THEN 'unknown id' WHEN NOT include AND pos % 2 = 0 THEN 'exclusion without a reason' END AS criteria_error FROM v_ann""",
    "v_ann",
)
def criteria_membership(spark, sf_dir):
    rows = views.annotations(spark, sf_dir)
    ids = F.expr("CASE pos % 3 WHEN 0 THEN array() WHEN 1 THEN array('I9') ELSE array('I1') END").cast("array<string>")
    rows = rows.withColumns({"inclusion_criteria_applied": ids, "exclusion_criteria_applied": F.array().cast("array<string>"), "reasoning": F.expr("CASE WHEN pos % 2 = 0 THEN 'none' ELSE 'fails I1' END")})
    mapping = spark.createDataFrame([("click", ["I1", "I2"], ["E1"])], "annotation_name string, inclusion array<string>, exclusion array<string>")
    return annotation.criteria_errors(rows, mapping).select("study_id", "analysis_id", "pos", "criteria_error")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS study_id, CASE WHEN event_id % 7 <> 0 THEN 'a' || (event_id % 3) END AS analysis_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS annotation_name,
    CASE WHEN event_id % 7 <> 0 THEN CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS include, CASE WHEN event_id % 7 = 0 THEN 'no analysis_id' WHEN event_id % 3 = 2 THEN 'no include' END AS error FROM events"""
)
def json_payload_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    include = F.expr("CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'false' ELSE 'perhaps' END")
    note = F.struct(F.col("event_type").alias("annotation_name"), include.alias("include"))
    good = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(" a"), (F.col("event_id") % 3).cast("string")).alias("analysis_id"), F.array(note).alias("annotations"))).alias("decisions")))
    rows = e.select(F.col("user_id").cast("string").alias("study_id"), F.lit(1).alias("attempt"), F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(good).alias("payload"))
    return annotation.parse_payload(rows).select("study_id", "analysis_id", "annotation_name", "include", "error")


@query("SELECT CAST(user_id AS VARCHAR) AS study_id, min(event_id % 3 + 1)::INTEGER AS attempt FROM events WHERE value > 34 GROUP BY user_id")
def retry_first_valid(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("study_id"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), (F.col("value") > 34).alias("valid"), F.col("props").alias("payload"))
    return annotation.first_valid(e).select("study_id", "attempt")


@query("SELECT CAST(user_id AS VARCHAR) AS study_id, arg_max(event_type, event_id) AS decision, max(event_id) AS pos FROM events WHERE event_id % 3 = 0 OR user_id NOT IN (SELECT user_id FROM events WHERE event_id % 3 = 0) GROUP BY user_id")
def screening_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("study_id"), F.col("event_type").alias("decision"), F.col("event_id").alias("pos"))
    merged = relational.upsert(rows.where("pos % 3 <> 0"), rows.where("pos % 3 = 0"), ["study_id"])
    return relational.last_by(merged, ["study_id"], "pos")


@query(
    """SELECT study_id AS pmid, analysis_id, a.table_id, coalesce(CASE WHEN t.p_size % 10 = 0 THEN NULL ELSE t.p_type END, 'Unnamed Table') AS table_caption, CASE WHEN t.p_partkey IS NULL THEN 'unknown table' END AS table_error
    FROM (SELECT DISTINCT study_id, analysis_id, CAST(CAST(study_id AS BIGINT) * 2 AS VARCHAR) AS table_id FROM v_ann) a LEFT JOIN part t ON CAST(t.p_partkey AS VARCHAR) = a.table_id""",
    "v_ann",
)
def table_lookup(spark, sf_dir):
    rows = views.analyses(spark, sf_dir).select(F.col("study_id").alias("pmid"), "analysis_id", (F.col("study_id").cast("long") * 2).cast("string").alias("table_id"))
    tables = table(spark, sf_dir, "part").select((F.col("p_partkey") / 2).cast("long").cast("string").alias("pmid"), F.col("p_partkey").cast("string").alias("table_id"), F.expr("CASE WHEN p_size % 10 = 0 THEN 'nan' ELSE p_type END").alias("table_caption"), F.lit(None).cast("string").alias("table_foot"))
    return annotation.with_table(rows, tables).select("pmid", "analysis_id", "table_id", "table_caption", "table_error")


# --- export


@query(
    """SELECT CAST(f.study AS VARCHAR) AS id, f.study || '_analysis_' || f.a AS analysis_id, f.study || '_analysis_' || f.a || '_point_' || (row_number() OVER (PARTITION BY f.study, f.a ORDER BY row_pos) - 1) AS point_id, CAST(round_even(x, 0) AS INTEGER) AS x, CAST(round_even(z, 0) AS INTEGER) AS z
    FROM (SELECT *, (dense_rank() OVER (PARTITION BY study ORDER BY table_id) - 1) AS a FROM v_foci) f""",
    "v_foci",
)
def study_records_nested(spark, sf_dir):
    points = retrieval.group_coordinates(views.foci(spark, sf_dir), "study").withColumnRenamed("study", "pos")
    points = points.withColumn("points", F.transform("points", lambda p: F.struct(p["coordinates"].alias("coordinates"), p["space"].alias("space"), F.array().cast("array<struct<value_text:string,value_num:double,kind:string>>").alias("values"))))
    ids = views.foci(spark, sf_dir).select(F.col("study").alias("pos")).distinct()
    none = F.lit(None).cast("string")
    rows = ids.select("pos", F.col("pos").cast("string").alias("pmid"), none.alias("doi"), none.alias("title"), none.alias("abstract"), none.alias("journal"), F.array().cast("array<string>").alias("authors"), none.alias("publication_date"), none.alias("coordinate_space"), F.lit(st.INCLUDED_FULLTEXT).alias("status"))
    nested = export.nimads_studies(export.exportable(retrieval.attach(rows, points, "pos", "analyses", "analysis_pos", True)))
    flat = nested.select("study.id", F.explode("study.analyses").alias("a")).select("id", F.col("a.id").alias("analysis_id"), F.explode("a.points").alias("p"))
    return flat.select("id", "analysis_id", F.col("p.id").alias("point_id"), F.col("p.coordinates")[0].alias("x"), F.col("p.coordinates")[2].alias("z"))


@query("SELECT count(*) AS total_analyses FROM (SELECT DISTINCT study, table_id FROM v_foci)", "v_foci")
def total_analyses(spark, sf_dir):
    points = retrieval.group_coordinates(views.foci(spark, sf_dir), "study")
    rows = views.foci(spark, sf_dir).select("study").distinct()
    return report.total_analyses(retrieval.attach(rows, points, "study", "analyses", "analysis_pos", True))


# --- meta-analysis

STEP, R = 4, 10


def _foci(spark, sf_dir):
    rows = views.foci(spark, sf_dir)
    return rows.select(F.col("table_id").alias("column"), F.col("study").cast("string").alias("unit"), "x", "y", "z")


_GRID = f""", g AS (SELECT table_id AS col, CAST(study AS VARCHAR) AS unit, CAST(round_even((x + 90) / {STEP}, 0) AS INTEGER) AS i, CAST(round_even((y + 126) / {STEP}, 0) AS INTEGER) AS j, CAST(round_even((z + 72) / {STEP}, 0) AS INTEGER) AS k FROM v_foci WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
  inside AS (SELECT * FROM g WHERE i BETWEEN 0 AND 45 AND j BETWEEN 0 AND 54 AND k BETWEEN 0 AND 45),
  r AS (SELECT unnest(generate_series(-2, 2)) AS v), ball AS (SELECT a.v AS a, b.v AS b, c.v AS c, ((a.v * a.v + b.v * b.v + c.v * c.v) * {STEP * STEP})::DOUBLE AS d2 FROM r a, r b, r c WHERE (a.v * a.v + b.v * b.v + c.v * c.v) * {STEP * STEP} <= {R * R}) """
_AT = "CAST((i + a) AS BIGINT) * 1000000 + (j + b) * 1000 + (k + c)"
_IN = "i + a BETWEEN 0 AND 45 AND j + b BETWEEN 0 AND 54 AND k + c BETWEEN 0 AND 45"
_MKDA = f'SELECT col AS "column", voxel, count(*) AS stat FROM (SELECT DISTINCT col, unit, {_AT} AS voxel FROM (SELECT DISTINCT * FROM inside), ball WHERE {_IN}) GROUP BY col, voxel'
_KDA = f'SELECT col AS "column", {_AT} AS voxel, count(*) AS stat FROM inside, ball WHERE {_IN} GROUP BY ALL'
_SIGMA2 = "(10.0 / (2 * sqrt(2 * ln(2)))) ** 2"
_ALE = f""", r3 AS (SELECT unnest(generate_series(-3, 3)) AS v), wide AS (SELECT * FROM (SELECT a.v AS a, b.v AS b, c.v AS c, ((a.v * a.v + b.v * b.v + c.v * c.v) * {STEP * STEP})::DOUBLE AS d2 FROM r3 a, r3 b, r3 c) WHERE d2 <= 9 * {_SIGMA2})
  SELECT col AS "column", voxel, round(1 - exp(sum(ln(1 - least(0.999999, {STEP**3} / (2 * pi() * {_SIGMA2}) ** 1.5 * exp(-d2 / (2 * {_SIGMA2})))))), 6) AS stat FROM
  (SELECT col, unit, {_AT} AS voxel, min(d2) AS d2 FROM (SELECT DISTINCT * FROM inside), wide WHERE {_IN} GROUP BY ALL) GROUP BY col, voxel"""
_SIZE = 46 * 55 * 46
_TAIL = "least(1.0, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(p) + (n - x) * ln(1 - p))))"
_MKDA_P = f""", s AS ({_MKDA}), m AS (SELECT col, unit, count(*) AS filled FROM (SELECT DISTINCT col, unit, {_AT} AS voxel FROM (SELECT DISTINCT * FROM inside), ball WHERE {_IN}) GROUP BY col, unit),
  f AS (SELECT col, count(*) AS n, sum(filled) / count(*) / {_SIZE}.0 AS p FROM m GROUP BY col), v AS (SELECT DISTINCT "column", stat FROM s),
  t AS (SELECT "column", stat, {_TAIL} AS p FROM (SELECT "column", stat, n, p, unnest(generate_series(stat, n)) AS x FROM v JOIN f ON col = "column") GROUP BY "column", stat)
  SELECT "column", voxel, stat, round(t.p, 9) AS p FROM s JOIN t USING ("column", stat)"""
_KDA_P = f""", s AS ({_KDA}), f AS (SELECT "column", sum(stat) / {_SIZE}.0 AS mean FROM s GROUP BY "column"), v AS (SELECT DISTINCT "column", stat FROM s),
  t AS (SELECT "column", stat, least(1.0, sum(exp(x * ln(mean) - mean - lgamma(x + 1)))) AS p FROM (SELECT "column", stat, mean, unnest(generate_series(stat, stat + 400)) AS x FROM v JOIN f USING ("column")) GROUP BY "column", stat)
  SELECT "column", voxel, stat, round(t.p, 9) AS p FROM s JOIN t USING ("column", stat)"""


@query(_GRID + _MKDA, "v_foci")
def mkda_counts(spark, sf_dir):
    return cbma.mkda(_foci(spark, sf_dir), STEP, R)


@query(_GRID + _KDA, "v_foci")
def kda_counts(spark, sf_dir):
    return cbma.kda(_foci(spark, sf_dir), STEP, R)


@query(_GRID + _ALE, "v_foci")
def ale_scores(spark, sf_dir):
    return cbma.ale(_foci(spark, sf_dir), STEP).withColumn("stat", F.round("stat", 6))


_P = 'SELECT event_type AS "column", event_id, (event_id % 997 + 1) / 1000.0::DOUBLE AS p FROM events'


def _tests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("column"), "event_id", ((F.col("event_id") % 997 + 1) / 1000.0).cast("double").alias("p"))


@query(
    f"""WITH t AS ({_P}), k AS (SELECT *, count(*) OVER (PARTITION BY "column" ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, count(*) OVER (PARTITION BY "column") AS n FROM t)
    SELECT "column", event_id, round(least(1.0, min(p * n / r) OVER (PARTITION BY "column" ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM k"""
)
def fdr_bh(spark, sf_dir):
    return cbma.fdr(_tests(spark, sf_dir)).select("column", "event_id", F.round("q", 9).alias("q"))


@query(f'WITH t AS ({_P}) SELECT "column", event_id, round(least(1.0, p * count(*) OVER (PARTITION BY "column")), 9) AS q FROM t')
def bonferroni(spark, sf_dir):
    return cbma.bonferroni(_tests(spark, sf_dir)).select("column", "event_id", F.round("q", 9).alias("q"))


@query(_GRID + _MKDA_P, "v_foci")
def mkda_p_values(spark, sf_dir):
    return cbma.mkda_tests(_foci(spark, sf_dir), STEP, R).withColumn("p", F.round("p", 9))


@query(_GRID + _KDA_P, "v_foci")
def kda_p_values(spark, sf_dir):
    foci = _foci(spark, sf_dir)
    return cbma.kda_p(cbma.kda(foci, STEP, R), foci, STEP, R).withColumn("p", F.round("p", 9))


@query()
def ale_p_values(spark, sf_dir):
    return cbma.ale_tests(_foci(spark, sf_dir), STEP)


@query()
def montecarlo_fwe(spark, sf_dir):
    foci = _foci(spark, sf_dir)
    return cbma.montecarlo(foci, cbma.mkda(foci, STEP, R), step=STEP)


@query()
def montecarlo_clusters(spark, sf_dir):
    foci = _foci(spark, sf_dir)
    tests = cbma.mkda_tests(foci, STEP, R)
    return cbma.montecarlo_clusters(foci, tests, step=STEP)


def _spaces_sql() -> str:
    moved = ", ".join(f"round(CASE WHEN space = 'TAL' THEN {a!r} * x + {b!r} * y + {c!r} * z + {d!r} ELSE {n} END, 6) AS {n}" for n, (a, b, c, d) in zip("xyz", coords.mni_from_tal()))
    points = "SELECT user_id || '_analysis_' || (event_id % 3) AS analysis_id, CAST(user_id AS VARCHAR) AS study_id, value - 50 AS x, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50 AS y, CAST(event_id % 91 - 45 AS DOUBLE) AS z, CASE event_id % 4 WHEN 0 THEN 'MNI' WHEN 1 THEN NULL ELSE 'TAL' END AS space FROM events"
    return f'SELECT annotation_name AS "column", analysis_id AS unit, study_id, {moved} FROM (SELECT DISTINCT annotation_name, analysis_id FROM v_ann WHERE include) n JOIN ({points}) p USING (analysis_id)'


@query(_spaces_sql(), "v_ann")
def foci_of_spaces(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    analysis = F.concat(F.col("user_id").cast("string"), F.lit("_analysis_"), (F.col("event_id") % 3).cast("string"))
    space = F.expr("CASE event_id % 4 WHEN 0 THEN 'MNI' WHEN 1 THEN NULL ELSE 'TAL' END")
    y = F.get_json_object("props", "$.k").try_cast("double") - 50
    points = e.select(analysis.alias("analysis_id"), F.col("user_id").cast("string").alias("study_id"), (F.col("value") - 50).alias("x"), y.alias("y"), (F.col("event_id") % 91 - 45).cast("double").alias("z"), space.alias("space"))
    notes = views.annotations(spark, sf_dir).select(F.col("annotation_name").alias("column"), "analysis_id", F.col("include").alias("value"))
    foci = cbma.slice_foci(points, notes)
    return foci.select("column", "unit", "study_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query()
def focus_counter(spark, sf_dir):
    foci = _foci(spark, sf_dir)
    stats = cbma.correct("fdr", foci, cbma.mkda_tests(foci, STEP, R), STEP)
    return cbma.focus_counter(foci, stats.where("q < 0.05"), STEP)


@query("SELECT annotation_name AS \"column\", analysis_id AS unit, study_id, z FROM (SELECT DISTINCT annotation_name, analysis_id FROM v_ann WHERE include) n JOIN (SELECT user_id || '_analysis_' || (event_id % 3) AS analysis_id, CAST(user_id AS VARCHAR) AS study_id, CAST(event_id % 91 - 45 AS DOUBLE) AS z FROM events) p USING (analysis_id) WHERE CAST(study_id AS BIGINT) IN (SELECT item_id FROM benchmark)", "v_ann")
def include_ids_slice(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    points = e.select(F.concat(F.col("user_id").cast("string"), F.lit("_analysis_"), (F.col("event_id") % 3).cast("string")).alias("analysis_id"), F.col("user_id").cast("string").alias("study_id"), F.col("value").alias("x"), F.col("value").alias("y"), (F.col("event_id") % 91 - 45).cast("double").alias("z"))
    notes = views.annotations(spark, sf_dir).select(F.col("annotation_name").alias("column"), "analysis_id", F.col("include").alias("value"))
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    return cbma.slice_foci(points, notes, ids).select("column", "unit", "study_id", "z")


@query("SELECT annotation_name AS \"column\", count(DISTINCT analysis_id) AS n FROM v_ann WHERE include AND annotation_name IN ('click', 'view') GROUP BY annotation_name", "v_ann")
def note_columns(spark, sf_dir):
    columns = annotation.boolean_columns({"click": "boolean", "view": "boolean", "purchase": "string"}, ["view", "absent", "click", "purchase"])
    rows = views.annotations(spark, sf_dir).where(F.col("annotation_name").isin(columns) & F.col("include") & (F.col("analysis_id") != ""))
    return rows.groupBy(F.col("annotation_name").alias("column")).agg(F.count_distinct("analysis_id").alias("n"))


@query(
    """SELECT annotation_name AS "column", count(*) AS analyses, count_if(v.analysis_id IS NULL)::BIGINT AS skipped FROM (SELECT DISTINCT annotation_name, analysis_id FROM v_ann WHERE include) n
    LEFT JOIN (SELECT DISTINCT user_id || '_analysis_' || (event_id % 3) AS analysis_id FROM events WHERE event_id % 5 = 0) v ON v.analysis_id = n.analysis_id GROUP BY annotation_name""",
    "v_ann",
)
def skipped_without_coordinates(spark, sf_dir):
    nothing = F.when(F.col("event_id") % 5 == 0, F.col("value")).when(F.col("event_id") % 5 == 1, F.lit(float("nan")))
    analysis = F.concat(F.col("user_id").cast("string"), F.lit("_analysis_"), (F.col("event_id") % 3).cast("string"))
    points = table(spark, sf_dir, "events").select(analysis.alias("analysis_id"), F.col("value").alias("x"), F.col("value").alias("y"), nothing.alias("z"))
    notes = views.annotations(spark, sf_dir).select(F.col("annotation_name").alias("column"), "analysis_id", F.col("include").alias("value"))
    return cbma.skipped(points, notes)


@query("SELECT DISTINCT doc_id + 1000000 AS pmcid FROM documents WHERE doc_id % 3 = 0 ORDER BY pmcid LIMIT 50")
def document_cap(spark, sf_dir):
    return retrieval.capped(views.studies(spark, sf_dir).where("pmcid is not null").select("pmcid").distinct(), 50)


@query(
    """SELECT CAST(user_id AS VARCHAR) AS study_id, CASE WHEN event_id % 3 <> 2 THEN user_id || '_analysis_' || event_id END AS analysis_id, CASE event_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN event_type END AS annotation_name,
    CASE event_id % 3 WHEN 0 THEN value > 34 WHEN 1 THEN true END AS include, CASE WHEN event_id % 3 = 2 THEN 'no analysis_id' END AS error FROM events"""
)
def single_decisions(spark, sf_dir):
    bare = F.to_json(F.struct((F.col("value") > 34).alias("include")))
    listed = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("annotation_name"), F.lit("yes").alias("include"))).alias("decisions")))
    payload = F.when(F.col("event_id") % 3 == 0, bare).when(F.col("event_id") % 3 == 1, listed).otherwise("{broken")
    item = F.concat(F.col("user_id").cast("string"), F.lit("_analysis_"), F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("study_id"), item.alias("item_id"), F.lit(1).alias("attempt"), payload.alias("payload"))
    return annotation.parse_payload(annotation.single_payloads(rows, ["click"])).select("study_id", "analysis_id", "annotation_name", "include", "error")


@query("SELECT CAST(page_id AS VARCHAR) AS pmid, 't' || page_id AS table_id, unnest(['first', 'second']) AS name, CAST(1 AS INTEGER) AS n_points, true AS parsed FROM pages")
def model_tables_udtf(spark, sf_dir):
    """Tables to analyses by a rule client, one table to many analyses."""
    from studyloom.operators.models import RuleClient, parse_tables

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("pmid"), F.lit(0).alias("table_pos"), F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("table_id"), F.col("html").alias("raw_table"))
    return parse_tables(pages, RuleClient()).select("pmid", "table_id", "name", F.size("points").alias("n_points"), "parsed")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Registered queries over records as a whole: documents to studies, prompts, notes,
attached tables, reports, and the table functions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom import sql as table_functions
from studyloom.functions import prompts
from studyloom.operators import annotation, export, retrieval
from studyloom.plans import views
from studyloom.plans.registry import query
from studyloom.plans.views import table
from studyloom.sources import pubmed

# --- documents of the search service

_SOUND = r"regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]', ' ')"  # what XML 1.0 can say, carriage returns left out
_ARTICLE = f"""concat('<PubmedArticle><MedlineCitation><PMID>', doc_id, '</PMID><Article><Journal>', if(doc_id % 7 = 0, '', concat('<Title>', source, '</Title>')),
  '<JournalIssue><PubDate>', if(doc_id % 4 = 0, '', '<Year>2020</Year>'), if(doc_id % 3 = 0, '', '<Month>May</Month>'), '<Day>', doc_id % 28 + 1, '</Day></PubDate></JournalIssue></Journal>',
  if(doc_id % 6 = 0, '', concat('<ArticleTitle>', source, '<i>inner</i></ArticleTitle>')),
  if(text is null, '', concat('<Abstract><AbstractText>', replace(replace(replace({_SOUND}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</AbstractText><AbstractText>second</AbstractText></Abstract>')),
  '<AuthorList><Author><LastName>', source, '</LastName>', if(doc_id % 2 = 0, '<ForeName>Jo</ForeName>', ''), '</Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList></Article>',
  '<KeywordList><Keyword>', lang, '</Keyword><Keyword></Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">', doc_id, '</ArticleId>',
  if(doc_id % 5 = 0, '', concat('<ArticleId IdType="doi">10.1/', doc_id, '</ArticleId><ArticleId IdType="doi">later</ArticleId>')), if(doc_id % 3 = 0, concat('<ArticleId IdType="pmc">PMC', doc_id, '</ArticleId>'), ''),
  '</ArticleIdList></PubmedData></PubmedArticle>')"""


@query(
    r"""SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 6 = 0 THEN 'Unknown Title' ELSE source END AS title, coalesce(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]', ' ', 'g'), '') AS abstract,
    CASE WHEN doc_id % 7 = 0 THEN 'Unknown Journal' ELSE source END AS journal, CASE WHEN doc_id % 2 = 0 THEN 'Jo ' ELSE '' END || source AS authors, CASE WHEN doc_id % 5 <> 0 THEN '10.1/' || doc_id END AS doi,
    CASE WHEN doc_id % 3 = 0 THEN doc_id END AS pmcid, trim(CASE WHEN doc_id % 4 = 0 THEN '' ELSE '2020' END || ' ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'May' END || ' ' || (doc_id % 28 + 1)) AS publication_date,
    lang AS keywords, 'pending' AS status FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL"""
)
def article_records(spark, sf_dir):
    """Documents as those of the search service, shredded by a lateral table function and
    made studies; nothing is shuffled."""
    table_functions.register(spark)
    whole = F.concat(F.lit("<PubmedArticleSet>"), F.expr(_ARTICLE), F.lit("</PubmedArticleSet>"))
    xml = table(spark, sf_dir, "documents").where("source is not null and lang is not null").select(whole.alias("xml"))
    records = spark.sql("SELECT r.* FROM {xml} AS x, LATERAL shred_articles(x.xml) AS r", xml=xml)
    rows = pubmed.studies(records)
    return rows.withColumns({"authors": F.array_join("authors", "; "), "keywords": F.array_join("keywords", "; ")})


# --- table functions


@query(
    """SELECT event_id, pos, CASE pos WHEN 0 THEN event_type ELSE 'other' END AS name, CASE WHEN pos = 0 THEN 1 ELSE 0 END AS n_points, CASE WHEN pos = 0 THEN value END AS x,
    CASE WHEN pos = 0 AND event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) END AS value_num FROM events, (SELECT unnest([0, 1]) AS pos) WHERE event_id % 5 <> 0"""
)
def lateral_analyses(spark, sf_dir):
    """Answers about tables to analyses in SQL: a point with two numbers goes, a value
    that is no number keeps its text only, and a broken answer gives none."""
    table_functions.register(spark)
    value = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise("n.s.")
    point = lambda *c: F.struct(F.array(*c).alias("coordinates"), F.lit("MNI").alias("space"), F.array(F.struct(value.alias("value"), F.lit("t").alias("kind"))).alias("values"))
    x, zero = F.col("value"), F.lit(0.0)
    made = F.array(F.struct(F.col("event_type").alias("name"), F.array(point(x, zero, zero), point(x, zero)).alias("points")), F.struct(F.lit("other").alias("name"), F.array(point(x)).alias("points")))
    answers = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.to_json(F.struct(made.alias("analyses")))).when(F.col("event_id") % 2 == 0, "{broken").alias("payload"))
    return spark.sql(
        "SELECT a.event_id, p.pos, p.name, size(p.points) AS n_points, get(p.points, 0).coordinates[0] AS x, get(p.points, 0).values[0].value_num AS value_num FROM {answers} AS a, LATERAL parse_analyses(a.payload) AS p",
        answers=answers,
    )


@query(
    """SELECT event_id, 'a' || user_id AS analysis_id, event_type AS annotation_name, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS include FROM events WHERE event_id % 5 <> 0"""
)
def lateral_decisions(spark, sf_dir):
    table_functions.register(spark)
    include = F.expr("CASE event_id % 3 WHEN 0 THEN ' Yes' WHEN 1 THEN 'FALSE\n' ELSE 'perhaps' END")
    note = F.struct(F.col("event_type").alias("annotation_name"), include.alias("include"))
    whole = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(" a"), F.col("user_id").cast("string")).alias("analysis_id"), F.array(note).alias("annotations"))).alias("decisions")))
    answers = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, whole).otherwise("[]").alias("payload"))
    return spark.sql("SELECT a.event_id, d.analysis_id, d.annotation_name, d.include FROM {answers} AS a, LATERAL parse_decisions(a.payload) AS d", answers=answers)


# --- prompts

_STAGE = {"objective": "Find studies", "criteria_mapping": {"inclusion": {"I1": "in English", "I2": "long"}, "exclusion": {"E1": "junk"}}, "additional_instructions": "Be brief"}
_HEAD = "Objective: Find studies\n\nInclusion criteria:\n- I1: in English\n- I2: long\n\nExclusion criteria:\n- E1: junk\n\nFurther instructions: Be brief\n\n"
_ASKED = "Answer with a JSON object: decision (INCLUDED or EXCLUDED), reason, confidence (between 0 and 1), inclusion_criteria_applied and exclusion_criteria_applied (lists of the ids that apply)"
_ABOUT = "'Title: ' || CASE WHEN doc_id % 4 = 0 THEN 'Untitled' ELSE coalesce(nullif(source, ''), 'Untitled') END || '\n\nAuthors: ' || CASE WHEN doc_id % 3 = 0 THEN 'Not available' ELSE 'A B, ' || lang END || '\n\nJournal: ' || coalesce(nullif(source, ''), 'Not available')"


@query(
    f"""SELECT doc_id, sha256('{_HEAD}' || {_ABOUT} || '\n\nAbstract: ' || coalesce(nullif(text, ''), 'No abstract available') || '\n\n{_ASKED}.') AS abstract_sha256,
    sha256('{_HEAD}' || {_ABOUT} || '\n\nAbstract: No abstract available\n\nFull text:\n' || text || '\n\n{_ASKED}, fulltext_incomplete (true or false).') AS fulltext_sha256 FROM documents WHERE lang IS NOT NULL"""
)
def screening_prompts(spark, sf_dir):
    """Digests of the prompts of both stages over whole texts; no text, no second prompt."""
    c = F.col
    authors = F.when(c("doc_id") % 3 != 0, F.array(F.lit("A B"), c("lang")))
    title = F.when(c("doc_id") % 4 == 0, "").otherwise(c("source"))
    first = prompts.screening(_STAGE, "abstract", title, c("text"), authors, c("source"))
    second = prompts.screening(_STAGE, "fulltext", title, F.lit(""), authors, c("source"), c("text"))
    return table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.sha2(first, 256).alias("abstract_sha256"), F.sha2(second, 256).alias("fulltext_sha256"))


@query(
    """SELECT page_id, sha256('List every analysis of this table with its points: three coordinates, the space (MNI, TAL or null) and values with their kind. Answer with a JSON object: analyses, a list of objects with name, description and points (coordinates, space, values).'
    || '\n\nCaption: ' || coalesce(nullif(CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE url END, ''), 'none') || '\nFooter: ' || CASE page_id % 2 WHEN 0 THEN 'foot' ELSE 'none' END || '\n\n' || html) AS prompt_sha256 FROM pages"""
)
def table_prompts(spark, sf_dir):
    caption = F.expr("CASE page_id % 3 WHEN 1 THEN '' WHEN 2 THEN url END")
    foot = F.expr("CASE page_id % 2 WHEN 0 THEN 'foot' END")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(prompts.table(caption, foot, F.col("html")), 256).alias("prompt_sha256"))


_RULES = [{"name": "pain", "description": "about pain", "criteria_mapping": {"inclusion": {"PAIN_I1": "pain"}}}, {"name": "rest", "description": None, "exclusion_criteria": ["a task"]}]
_RULES_TEXT = "Annotation pain: about pain\nInclusion criteria:\n- PAIN_I1: pain\nAnnotation rest: \nExclusion criteria:\n- a task"
_OF_NOTES = "annotation_name, include (true or false), reasoning, inclusion_criteria_applied and exclusion_criteria_applied (lists of the ids that apply)."


@query(
    f""", a AS (SELECT study_id, analysis_id, row_number() OVER (PARTITION BY study_id ORDER BY analysis_id) AS pos FROM (SELECT DISTINCT study_id, analysis_id FROM v_ann)),
    t AS (SELECT study_id, pos % 2 AS tab, min(pos) AS first, string_agg('- ' || analysis_id || ' | name ' || pos, '\n' ORDER BY pos) AS items FROM a GROUP BY study_id, pos % 2)
    SELECT study_id, '{_RULES_TEXT}\n\nTitle: ' || CASE WHEN CAST(study_id AS BIGINT) % 2 = 0 THEN 'study ' || study_id ELSE 'Untitled' END || '\n\nAbstract: No abstract available\n\nAnalyses:\n'
      || string_agg('Table: ' || CASE WHEN tab = 0 THEN 'even' ELSE 'Unnamed Table' END || '\n' || CASE WHEN tab = 0 THEN 'Footer: foot\n' ELSE '' END || items, '\n' ORDER BY first)
      || '\n\nDecide on every annotation for every analysis. Answer with a JSON object: decisions, a list of objects with analysis_id and annotations, a list of objects with {_OF_NOTES}' AS prompt FROM t GROUP BY study_id""",
    "v_ann",
)
def annotation_prompts(spark, sf_dir):
    """One prompt a study, its analyses under their tables in the order of the first."""
    listed = views.analyses(spark, sf_dir).groupBy("study_id").agg(F.array_sort(F.collect_list("analysis_id")).alias("ids"))

    def item(x, i):
        odd, name = (i + 1) % 2, F.concat(F.lit("name "), (i + 1).cast("string"))
        return F.struct(x.alias("id"), name.alias("name"), F.lit("not told").alias("description"), odd.alias("table_id"), F.when(odd == 0, "even").alias("table_caption"), F.when(odd == 0, "foot").alias("table_foot"))

    study = F.struct(F.when(F.col("study_id").cast("long") % 2 == 0, F.concat(F.lit("study "), "study_id")).alias("title"), F.lit("").alias("abstract"), F.lit(None).cast("string").alias("fulltext"), F.transform("ids", item).alias("analyses"))
    return listed.select("study_id", prompts.annotation(study, ["analysis_name", "study_abstract"], _RULES).alias("prompt"))


@query(
    f"""SELECT doc_id, sha256('{_RULES_TEXT}\n\n' || coalesce(nullif(array_to_string(list_filter([CASE WHEN regexp_matches(source, '\\S') AND doc_id % 3 = 0 THEN '- Analysis name: ' || source END, CASE WHEN regexp_matches(text, '\\S') THEN '- Study abstract: ' || text END,
    CASE WHEN regexp_matches(lang, '\\S') AND doc_id % 2 = 0 THEN '- Of Language: ' || lang END], lambda x: x IS NOT NULL), '\n'), ''), 'Nothing is known about the analysis.')
    || '\n\nDecide on every annotation for this one analysis; what the table or the study says of other analyses does not count. Answer with a JSON object: decisions, a list of objects with {_OF_NOTES}') AS prompt_sha256 FROM documents"""
)
def single_prompts(spark, sf_dir):
    """One prompt an analysis, with the fields that are asked for and filled."""
    none = F.lit(None).cast("string")
    told = {"analysis_name": F.when(F.col("doc_id") % 3 == 0, F.col("source")), "study_abstract": F.col("text"), "study_title": F.lit("not asked for")}
    about = F.struct(*[told.get(f, none).alias(f) for f in prompts.METADATA])
    custom = {"of_language": F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "other": F.lit("not asked for")}
    made = prompts.single_analysis(about, ["analysis_name", "study_abstract", "table_caption", "of_language"], _RULES, custom)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("prompt_sha256"))


# --- what hangs on studies

_NAMES = ("click", "view")


@query(
    "SELECT analysis_id AS analysis, 'ann' AS annotation, " + ", ".join(f"coalesce(arg_max(include, pos) FILTER (annotation_name = '{n}'), false) AS \"{n}\"" for n in _NAMES) + " FROM v_ann GROUP BY analysis_id",
    "v_ann",
)
def note_rows(spark, sf_dir):
    """Rows of the annotation's document; quotes in ids go, as in the study set."""
    notes = annotation.notes(views.annotations(spark, sf_dir), views.analyses(spark, sf_dir), list(_NAMES))
    quoted = notes.withColumn("analysis_id", F.concat(F.lit("'"), "analysis_id", F.lit('" ')))
    return export.note_rows(quoted, list(_NAMES), "ann").select("analysis", "annotation", *[F.col("note")[n].alias(n) for n in _NAMES])


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own;' ELSE '' END || string_agg(o_orderpriority || o_orderkey, ';' ORDER BY o_orderkey) AS tables FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
    UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own' END FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"""
)
def attached_tables(spark, sf_dir):
    """Tables behind those that a study has; studies without new ones stay as they are."""
    own = F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(F.lit("own").alias("table_id"))))
    studies = table(spark, sf_dir, "customer").select("c_custkey", own.alias("tables"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("pos"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("table_id"))
    rows = retrieval.attach(studies, new, "c_custkey", "tables", "pos", False)
    return rows.select("c_custkey", F.array_join(F.transform("tables", lambda t: t["table_id"]), ";").alias("tables"))


def _with_points(spark, sf_dir):
    points = retrieval.group_coordinates(views.foci(spark, sf_dir), "study").withColumnRenamed("study", "pos")
    return retrieval.attach(views.screened(spark, sf_dir), points, "pos", "analyses", "analysis_pos", True)


@query(
    "SELECT pmid, pmcid, status, full_text_path, fulltext_available, pos IN (SELECT study FROM v_foci WHERE study IS NOT NULL AND table_id IS NOT NULL) AS coordinates_found FROM v_studies WHERE fulltext_available OR pmcid IS NOT NULL",
    "v_studies", "v_foci",
)
def retrieval_report(spark, sf_dir):
    rows = _with_points(spark, sf_dir).withColumn("retrieved_at", F.lit(None).cast("timestamp"))
    return retrieval.report(rows).select("pmid", "pmcid", "status", "full_text_path", "fulltext_available", "coordinates_found")


@query(
    "SELECT pmid, status = 'included_fulltext' AS by_default FROM v_studies WHERE pos IN (SELECT study FROM v_foci WHERE study IS NOT NULL AND table_id IS NOT NULL)", "v_studies", "v_foci"
)
def export_scope(spark, sf_dir):
    """Studies that an export may hold, and whether it does unless told otherwise."""
    rows = _with_points(spark, sf_dir)
    usual = export.exportable(rows).select("pmid", F.lit(True).alias("by_default"))
    return export.exportable(rows, True).select("pmid").join(usual, "pmid", "left").select("pmid", F.coalesce("by_default", F.lit(False)).alias("by_default"))


@query(
    """SELECT study_id, analysis_id, table_id, CASE WHEN n = 0 THEN 'no tables' ELSE 'unknown table' END AS reason FROM (SELECT CAST(user_id AS VARCHAR) AS study_id, user_id || '_analysis_' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS analysis_id,
    CASE WHEN event_id % 4 > 0 THEN 't' || (event_id % 4) END AS table_id, event_id % 4 AS t, user_id % 3 AS n FROM events) WHERE table_id IS NOT NULL AND t > n"""
)
def quarantined(spark, sf_dir):
    """Analyses of tables that their study lacks; one that names no table is sound."""
    listed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    analyses = F.transform("l", lambda e: F.struct(F.when(e % 4 > 0, F.concat(F.lit("t"), (e % 4).cast("string"))).alias("table_id")))
    tables = F.filter(F.array(F.struct(F.lit("t1").alias("table_id")), F.struct(F.lit("t2").alias("table_id"))), lambda _, i: i < F.col("user_id") % 3)
    return annotation.quarantine(listed.select(F.col("user_id").cast("string").alias("pmid"), tables.alias("activation_tables"), analyses.alias("analyses")))

"""Sources, sinks, configuration, command line, pipeline, streaming: round trips."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from studyloom import cli
from studyloom import config as cfg
from studyloom.functions import status as st
from studyloom.operators import models
from studyloom.pipeline import Review, run_meta
from studyloom.sources import files, pubmed, sinks
from studyloom.streaming.upserts import arrivals, stream_upserts

XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2023</Year><Day>05</Day></PubDate></JournalIssue></Journal>
<ArticleTitle>A <i>b</i> c</ArticleTitle><Abstract><AbstractText>first</AbstractText><AbstractText>second</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList></Article>
<KeywordList><Keyword>k</Keyword><Keyword></Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId><ArticleId IdType="pmc">PMC77</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle></PubmedArticle></PubmedArticleSet>"""


@pytest.mark.parametrize(("low", "high", "parts"), [("2020/01/01", None, ["2020/01/01", "3000"]), (None, "2020/12/31", ["1900", "2020/12/31"]), ("2020/01/01", "2020/12/31", ["2020/01/01", "2020/12/31"])])
def test_query(low, high, parts):
    query = pubmed.build_query("x", low, high)
    assert query.count("[Date - Publication]") == 2 and all(f'{p}"[Date - Publication]' in query for p in parts) and pubmed.build_query("x") == "x"


def test_pubmed_records(spark):
    rows = pubmed.studies(pubmed.articles(spark.createDataFrame([(XML,), ("<broken",), (None,)], "xml string"))).collect()
    a, b = sorted(rows, key=lambda r: r["pmid"])
    assert (a["title"], a["abstract"], a["authors"], a["publication_date"], a["doi"], a["pmcid"], a["keywords"]) == ("A ", "first", ["J Doe"], "2023  05", "10.1/x", 77, ["k"])
    assert (b["pmid"], b["title"], b["abstract"], b["publication_date"]) == ("Unknown", "Unknown Title", "", "Unknown Date")


def test_remote_calls(spark):
    def fetch(url, params, **_):
        if "esearch" in url:
            return json.dumps({"esearchresult": {"idlist": ["5", "4"]}}).encode()
        if "efetch" in url:
            return XML.encode()
        return json.dumps({"records": [{"pmid": "5", "pmcid": "PMC9"}, {"pmid": "4"}]}).encode()

    ids = pubmed.search_ids(spark, "q", fetch=fetch)
    assert [tuple(r) for r in ids.orderBy("rank").collect()] == [("5", 0), ("4", 1)]
    assert pubmed.articles(pubmed.fetch_xml(ids, fetch, 0)).count() >= 2
    assert [tuple(r) for r in pubmed.convert_ids(ids.coalesce(1), fetch, 0).collect()] == [("5", 9)]
    calls = []

    def failing(*_a, **_k):
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        pubmed.get("http://x", {}, wait=0, opener=failing)
    assert len(calls) == 3


def test_corpora(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    for name, body in (("12.txt", "a"), ("x.txt", "b"), ("13.html", "c"), ("0.txt", "z")):
        (tmp_path / "flat" / name).write_text(body)
    assert {(r["pmid_number"], r["body"]) for r in files.corpus(spark, str(tmp_path / "flat")).collect()} == {(12, "a")}
    for pmid, names in (("21", ("text.txt", "p/full.txt")), ("22", ("text.txt",)), ("no", ("text.txt",))):
        for n in names:
            p = tmp_path / "dirs" / pmid / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(n)
    (tmp_path / "dirs" / "no" / "identifiers.json").write_text('{"pmid": "23"}')
    got = files.corpus(spark, str(tmp_path / "dirs"), "folder_name", templates=("p/full.txt", "text.txt"))
    assert {(r["pmid_number"], r["body"]) for r in got.collect()} == {(21, "p/full.txt"), (22, "text.txt")}
    got = files.corpus(spark, str(tmp_path / "dirs"), "json", templates=("text.txt",))
    assert {r["pmid_number"] for r in got.collect()} == {23}


def test_csv_folder(spark, tmp_path):
    (tmp_path / "text.csv").write_text('pmcid,body\n123456,"This is the full\ntext for study 1."\n789012,"say ""x"""\n')
    (tmp_path / "coordinates.csv").write_text("pmcid,table_id,table_label,x,y,z\n1.0,t1,L,1,2,3\n1.0,t1,L,4,5,nan\nNA,t2,L,1,1,1\n")
    (tmp_path / "tables.csv").write_text("pmcid,table_id,table_label,table_caption,table_foot,table_raw_file\n1,t1,L,cap,,raw.xml\n1,t2,L,cap,,\n")
    body = files.csv(spark, str(tmp_path / "text.csv"))
    studies = spark.createDataFrame([("s", 123456, None), ("t", 1, None)], "pmid string, pmcid long, full_text_path string")
    got = files.fulltexts(studies, spark.createDataFrame([], "path string, body string"), body)
    assert {r["pmid"]: r["body"] for r in got.collect()} == {"s": "This is the full\ntext for study 1.", "t": None}
    points = files.coordinates(spark, str(tmp_path / "coordinates.csv"))
    assert sorted((r["pmcid"] or 0, r["z"]) for r in points.collect() if r["z"] is not None) == [(0, 1.0), (1, 3.0)]
    rows = files.tables(spark, str(tmp_path / "tables.csv"), "/root").orderBy("table_id").collect()
    assert [r["table_raw_path"] for r in rows] == ["/root/raw.xml", None]
    with pytest.raises(ValueError):
        files.coordinates(spark, str(tmp_path / "tables.csv"))


def test_engines(spark, tmp_path):
    from studyloom.engines import CsvFolderRetriever, LocalRetriever, PubMedSearch

    for folder, names in (("a", ("1.txt",)), ("b", ("1.txt", "2.txt"))):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text(f"{folder} {n}")
    schema = "pmid string, pmcid long, full_text_path string, full_text_source string, fulltext_available boolean, retrieval_in_scope boolean, retrieved_at timestamp"
    studies = spark.createDataFrame([("1", 11, None, None, None, True, None), ("2", 12, None, None, None, False, None), ("3", 13, None, None, None, True, None)], schema)
    local = LocalRetriever([{"root_path": str(tmp_path / "a"), "name": "first"}, {"root_path": str(tmp_path / "b")}])
    got = local.retrieve(studies)
    assert {r["pmid"]: r["full_text_source"] for r in got.collect()} == {"1": "first", "2": None, "3": None}
    assert [r["pmid"] for r in local.missing(got).collect()] == ["3"]
    (tmp_path / "metadata.csv").write_text("pmcid\n11\n")
    (tmp_path / "text.csv").write_text("pmcid,body\n13,x\n")
    asked = []
    folder = CsvFolderRetriever(str(tmp_path), lambda ids: asked.extend(r["pmcid"] for r in ids.collect()))
    assert {r["pmid"]: r["fulltext_available"] for r in folder.retrieve(studies).collect()} == {"1": False, "2": False, "3": True} and asked == [13]
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "pmcid_7_t1.csv").write_text("x,y\n1,2\n")
    info = spark.createDataFrame([("tables/pmcid_7_t1.csv", "old"), ("tables/pmcid_7_t1.csv", "new")], "table_data_file string, table_caption string").coalesce(1)
    (row,) = files.table_files(spark, str(tmp_path / "tables"), info).collect()
    assert (row["table_id"], row["table_caption"]) == ("pmcid_7_t1", "new")
    listed = PubMedSearch().ids(spark, cfg.SearchConfig(pmids_list=["4", "4"]))
    assert [r["pmid"] for r in listed.collect()] == ["4", "4"]


def test_criteria_ids_and_validation():
    given = {"search": {"query": "q"}, "screening": {"abstract": {"objective": "o", "inclusion_criteria": ["a", "b", "c"], "exclusion_criteria": ["d", "e", "f"]}, "fulltext": {"objective": "o", "inclusion_criteria": ["g", "h"], "exclusion_criteria": ["i"]}}, "annotation": {"inclusion_criteria": ["x"], "annotations": [{"name": "affiliation attachment", "inclusion_criteria": ["y"]}, {"name": "bare"}]}}
    config = cfg.from_dict(given)
    assert list(config.screening.fulltext["criteria_mapping"]["inclusion"]) == ["I4", "I5"] and list(config.screening.fulltext["criteria_mapping"]["exclusion"]) == ["E4"]
    first, second = cfg.injected_criteria(config)
    assert first.criteria_mapping["inclusion"] == {"GLOBAL_I1": "x", "AFFILIATION_ATTACHMENT_I1": "y"} and second.criteria_mapping is None
    for change in ({"search": {"query": " "}}, {"search": {"query": "q", "max_results": 0}}, {"search": {"query": "q", "database": "pmc"}}, {"output": {"directory": " "}}, {"screening": {}}, {"annotation": {"create_all_included_annotation": True}}, {"retrieval": {"full_text_source": {"coordinates_path_templates": ["a"], "processed_data_path": "b"}}}, {"search": {"what": 1}}):
        with pytest.raises(cfg.ConfigurationError):
            cfg.from_dict({**given, **change})


def test_command_line(tmp_path, capsys):
    path = tmp_path / "review.yml"
    path.write_text(cfg.SAMPLE)
    assert cli.main(["validate", str(path)]) == 0 and str(tmp_path / "review") in capsys.readouterr().out
    assert cli.main(["run", str(path), "--dry-run"]) == 0
    assert cli.main(["validate", str(tmp_path / "none.yml")]) == 1
    assert cli.main(["create-sample-config"]) == 0
    assert cli.main(["meta", str(tmp_path), "--estimator-args", "{bad"]) == 1
    config = cfg.load(path)
    cfg.save(config, tmp_path / "copy" / "c.yml")
    assert (tmp_path / "copy" / "c.yml").exists()


def test_review_end_to_end(spark, tmp_path):
    table = "struct<table_id:string,table_label:string,table_caption:string,table_foot:string,table_data_path:string,table_raw_path:string,raw_table:string>"
    found = spark.createDataFrame(
        [("1", 0, "study one", "a study of memory", [("t1", "T", "cap", None, None, None, "x,y,z")]), ("2", 1, "other", "nothing here", None), ("3", 2, "empty", " ", None), ("4", 3, "study four", "a study too", None)],
        f"pmid string, pos long, title string, abstract string, activation_tables array<{table}>",
    ).withColumn("status", F.lit(st.PENDING))
    config = cfg.from_dict({"search": {"query": "q"}, "screening": {k: {"objective": "find", "inclusion_criteria": ["memory"]} for k in ("abstract", "fulltext")}, "parsing": {"parse_coordinates": True}, "output": {"directory": str(tmp_path), "nimads": True}})
    texts = spark.createDataFrame([("1", "study text", "/texts/1.txt")], "pmid string, body string, path string")
    run = lambda stop=None: Review(spark, config, models.RuleClient(), lambda _s, _c: found, texts).run(stop)
    assert run("search")["pending_studies"] == 4
    # the title of study 2 has no word of the rule either
    assert run(" Abstract ") | {"seconds": 0} == {"total_studies": 4, "included_studies": 0, "excluded_studies": 1, "pending_studies": 1, "seconds": 0}
    stats = run()
    assert stats["included_studies"] == 1
    out = tmp_path / "outputs"
    (study,) = json.loads((out / "nimads_studyset.json").read_text())["studies"]
    assert study["id"] == "1" and [a["id"] for a in study["analyses"]] == ["1_analysis_0", "1_analysis_1"]
    note = json.loads((out / "nimads_annotation.json").read_text())
    assert {n["analysis"] for n in note["notes"]} == {"1_analysis_0", "1_analysis_1"} and note["notes"][0]["note"]["all_analyses"] is True
    assert "4,unavailable" in (out / "missing_fulltexts.csv").read_text()
    assert (out / "missing_fulltexts.txt").read_text() == "4\n"
    stored = files.screening_cache(spark, str(out / "abstract_screening_results.json"))
    assert {r["study_id"]: r["decision"] for r in stored.collect()} == {"1": st.INCLUDED_ABSTRACT, "2": st.EXCLUDED_ABSTRACT, "4": st.INCLUDED_ABSTRACT}
    assert files.search_cache(spark, str(out / "search_results.json")).count() == 4
    assert files.annotation_cache(spark, str(out / "annotation_results.json")).count() == 6
    cached = files.coordinate_cache(spark, str(out / "coordinate_parsing_results.json"))
    bare = spark.createDataFrame([("1",), ("9",)], "pmid string").withColumn("analyses", F.lit(None).cast(cached.schema["analyses"].dataType))
    assert {r["pmid"]: len(r["analyses"] or []) for r in files.with_cached_analyses(bare, cached).collect()} == {"1": 2, "9": 0}
    ids = {(r["scope"], r["id"]) for r in files.criteria_ids(spark, str(out / "criteria_mapping.json")).collect()}
    assert ids == {("abstract", "I1"), ("fulltext", "I2")}
    assert json.loads((out / "fulltext_retrieval_results.json").read_text())["studies"][0]["coordinates_found"] is True
    with pytest.raises(ValueError):
        run("later")
    maps = run_meta(spark, str(tmp_path))
    assert maps.count() > 0 and {r["column"] for r in maps.select("column").distinct().collect()} == {"all_abstract", "all_analyses", "all_studies"}


def test_stream_upserts(spark, tmp_path):
    schema = "study_id string, decision string, screening_type string, ts timestamp"
    for k, rows in enumerate(([("1", "a"), ("2", "a")], [("1", "b"), ("3", "c")])):
        made = [(s, d, "abstract", f"2024-01-01 0{k}:00:00") for s, d in rows]
        spark.createDataFrame(made, "study_id string, decision string, screening_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a restart changes nothing
        stream_upserts(stream(), f"{tmp_path}/out", f"{tmp_path}/ck", ["study_id"], "ts").awaitTermination()
        assert {r["study_id"]: r["decision"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"1": "b", "2": "a", "3": "c"}
    q = arrivals(stream(), "ts").writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrived").agg(F.sum("n")).first()[0] == 4


def test_document_is_replaced(spark, tmp_path):
    for k in (1, 2):
        sinks.document(spark.createDataFrame([(f"v{k}",)], "v string"), f"{tmp_path}/d.json")
    assert (tmp_path / "d.json").read_text() == "v2\n" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["d.json"]


class Scripted(models.ModelClient):
    """Screens by rule; answers annotation and table requests from a list, and keeps
    what was asked."""

    def __init__(self, answers):
        self.answers, self.asked, self.rule = answers, [], models.RuleClient()

    def respond(self, requests):
        rows = requests.select("task", "study_id", "item_id").collect()
        self.asked += [(r["task"], r["study_id"]) for r in rows]
        if not rows or rows[0]["task"] not in self.answers:
            return self.rule.respond(requests)
        left = self.answers[rows[0]["task"]]
        payload = left.pop(0) if len(left) > 1 else left[0]
        return requests.select("task", "study_id", "item_id", F.lit(1).alias("attempt"), F.lit(payload).alias("payload"))


def test_review_from_files_to_meta_analysis(spark, tmp_path):
    texts, data, out = tmp_path / "texts", tmp_path / "data", tmp_path / "out"
    for folder in (texts, data):
        folder.mkdir()
    for pmid in (11, 12):
        (texts / f"{pmid}.txt").write_text(f"a full study text of {pmid}")
    (data / "coordinates.csv").write_text("pmid,table_id,table_label,x,y,z\n11,t2,Table 2,10,20,30\n11,t1,Table 1,1,2,3\n11,t1,Table 1,4,5,6\n12,t1,Table 1,10,20,30\n99,t1,none,0,0,0\n")
    (data / "tables.csv").write_text("pmid,table_id,table_label,table_caption,table_foot,table_raw_file,table_data_file\n11,t1,Table 1,a caption,,raw.xml,\n11,t2,Table 2,,,,\n12,t1,Table 1,,,,\n")
    (data / "raw.xml").write_text("<table/>")
    config = cfg.from_dict({
        "search": {"query": "q"}, "screening": {k: {"objective": "find", "inclusion_criteria": ["memory"]} for k in ("abstract", "fulltext")},
        "retrieval": {"full_text_sources": [{"root_path": str(texts), "processed_data_path": str(data), "source_name": "mine"}]},
        "annotation": {"annotations": [{"name": "memory", "description": "about memory"}]}, "output": {"directory": str(out), "nimads": True},
    })
    found = spark.createDataFrame([("11", 0, "one", "a study"), ("12", 1, "two", "a study"), ("13", 2, "three", "a study")], "pmid string, pos long, title string, abstract string").withColumn("status", F.lit(st.PENDING))

    class Engine:
        fetched = []

        def ids(self, spark, _config):
            return found.select("pmid")

        def details(self, ids):
            self.fetched.append(sorted(r["pmid"] for r in ids.collect()))
            return found.join(ids, "pmid", "left_semi")

        def pmcids(self, ids):
            return ids.select("pmid", F.lit(7).cast("long").alias("pmcid"))

    notes = lambda n, study: {"analysis_id": f"{study}_analysis_{n}", "annotations": [{"annotation_name": "memory", "include": True, "reasoning": "r"}]}
    whole = {"11": [notes(0, "11"), notes(1, "11")], "12": [notes(0, "12")]}

    class Annotator(Scripted):
        tries = {}

        def respond(self, requests):
            rows = requests.select("task", "study_id").collect()
            if not rows or rows[0]["task"] != "annotation":
                return super().respond(requests)
            made = []
            for r in rows:
                self.asked.append((r["task"], r["study_id"]))
                n = self.tries[r["study_id"]] = self.tries.get(r["study_id"], 0) + 1
                # study 11 answers badly twice: broken, then with an analysis it does not have
                bad = {("11", 1): "{", ("11", 2): json.dumps({"decisions": [*whole["11"], notes(9, "11")]})}.get((r["study_id"], n))
                made.append(("annotation", r["study_id"], None, n, bad or json.dumps({"decisions": whole[r["study_id"]]})))
            return spark.createDataFrame(made, models.RESPONSES)

    client, engine = Annotator({}), Engine()
    Review(spark, config, client, engine).run()
    studies = {r["pmid"]: r for r in spark.read.parquet(f"{out}/outputs/tables/studies").collect()}
    assert [(a["table_id"], a["description"], [p["coordinates"] for p in a["points"]]) for a in studies["11"]["analyses"]] == [("t1", "Table 1", [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), ("t2", "Table 2", [[10.0, 20.0, 30.0]])]
    assert [(t["table_caption"], t["raw_table"]) for t in studies["11"]["activation_tables"]] == [("a caption", "<table/>"), (None, None)]
    assert (studies["11"]["full_text_source"], studies["13"]["pmcid"], studies["13"]["analyses"]) == ("mine", 7, None)
    asked = [s for t, s in client.asked if t == "annotation"]
    assert (asked.count("11"), asked.count("12")) == (3, 1)
    decisions = {(r["analysis_id"], r["include"]) for r in spark.read.parquet(f"{out}/outputs/tables/annotations").where("annotation_name = 'memory'").collect()}
    assert decisions == {("11_analysis_0", True), ("11_analysis_1", True), ("12_analysis_0", True)}
    Review(spark, config, client, engine).run()  # nothing is fetched or asked again
    assert engine.fetched == [["11", "12", "13"], []] and [s for t, s in client.asked if t == "annotation"] == asked
    again = {(r["analysis_id"], r["include"]) for r in spark.read.parquet(f"{out}/outputs/tables/annotations").where("annotation_name = 'memory'").collect()}
    assert again == decisions
    maps = run_meta(spark, str(out), "kda", "bonferroni")
    assert "memory" in {r["column"] for r in maps.select("column").distinct().collect()}
    assert files.exists(spark, f"{out}/outputs/meta_clusters")


def test_requests_carry_schema_model_and_partitions(spark):
    client = models.HttpClient({"abstract": "a", "annotation": "b"}, api_key="k", workers=3)
    body = client.body("annotation", "p")
    schema = body["response_format"]["json_schema"]["schema"]
    one = schema["properties"]["decisions"]["items"]["properties"]["annotations"]["items"]
    assert body["model"] == "b" and one["properties"]["include"] == {"type": "boolean"} and "annotation_name" in one["required"]
    assert models.answer_schema("abstract")["properties"]["decision"]["enum"] == ["INCLUDED", "EXCLUDED"]
    asked = spark.range(9).select(F.lit("abstract").alias("task"), F.col("id").cast("string").alias("study_id"), F.lit(None).cast("string").alias("item_id"), F.lit("p").alias("prompt"))
    assert client.respond(asked).rdd.getNumPartitions() == 3


def test_single_analyses(spark, tmp_path):
    from studyloom.engines import CsvFolderRetriever
    from studyloom.functions import prompts
    from studyloom.operators import annotation, export

    # one request for each analysis; study 1 answers without a list, then with one
    config = cfg.from_dict({
        "search": {"query": "q"}, "screening": {k: {"objective": "find", "inclusion_criteria": ["memory"]} for k in ("abstract", "fulltext")},
        "annotation": {"annotations": [{"name": "memory"}], "prompt_type": "single_analysis"}, "output": {"directory": str(tmp_path)},
    })
    client = Scripted({"annotation_single": ["{", json.dumps({"include": "yes", "reasoning": "r"})]})
    analysis = "struct<name:string,description:string,table_id:string,parsed:boolean,points:array<struct<coordinates:array<double>,space:string,values:array<struct<value_text:string,value_num:double,kind:string>>>>>"
    rows = spark.createDataFrame([("1", "t", st.INCLUDED_FULLTEXT, [("a", "d", None, False, []), ("b", None, None, False, [])])], f"pmid string, title string, status string, analyses array<{analysis}>")
    from studyloom.pipeline import conform

    got = Review(spark, config, client, lambda _s, _c: rows).custom_decisions(conform(rows)).collect()
    assert {(r["analysis_id"], r["annotation_name"], r["include"]) for r in got} == {("1_analysis_0", "memory", True), ("1_analysis_1", "memory", True)}
    assert client.asked == [("annotation_single", "1")] * 4
    assert models.HttpClient({"annotation": "b"}, api_key="k").body("annotation_single", "p")["model"] == "b"

    # several annotations: a bare decision belongs to none of them
    bare = spark.createDataFrame([("1", "x", 1, '{"include": true}')], "study_id string, item_id string, attempt int, payload string")
    assert annotation.parse_payload(annotation.single_payloads(bare, ["a", "b"])).first()["error"] == "no analysis_id"

    items = spark.createDataFrame([([("i0", "n0", None, "t2", "two", "foot"), ("i1", "n1", None, "t1", None, None), ("i2", "n2", None, "t2", "two", "foot"), ("i3", "n3", None, None, None, None)],)], "analyses array<struct<id:string,name:string,description:string,table_id:string,table_caption:string,table_foot:string>>")
    study = F.struct(F.lit("T").alias("title"), F.lit("A").alias("abstract"), F.lit(None).cast("string").alias("fulltext"), F.col("analyses"))
    text = items.select(prompts.annotation(study, ["analysis_name"], [{"name": "memory"}])).first()[0]
    assert "Table: two\nFooter: foot\n- i0 | n0\n- i2 | n2\nTable: Unnamed Table\n- i1 | n1\nTable: Unnamed Table\n- i3 | n3" in text
    about = F.struct(*[F.lit("v" if f == "study_title" else None).cast("string").alias(f) for f in prompts.METADATA])
    text = items.select(prompts.single_analysis(about, ["study_title", "study_journal", "sample_size"], [{"name": "memory"}], {"sample_size": F.lit("9")})).first()[0]
    assert "- Study title: v\n- Sample Size: 9" in text and "journal" not in text

    # ids of notes are cleaned as those of analyses
    notes = spark.createDataFrame([("o'k_analysis_0 ", True)], "analysis_id string, m boolean")
    assert export.nimads_annotation(notes, ["m"], "a", "s", "n").first()["notes"][0]["analysis"] == "ok_analysis_0"

    parsed = spark.createDataFrame([("t1", '{"analyses": []}'), ('q"', None)], "table_id string, payload string")
    sinks.by_table(parsed, f"{tmp_path}/parsed")
    assert json.loads((tmp_path / "parsed" / "all_results.json").read_text()) == {"t1": {"analyses": []}, 'q"': None}
    assert spark.read.text(f"{tmp_path}/parsed/tables").where("table_id = 't1'").first()["value"] == '{"analyses": []}'

    (tmp_path / "metadata.csv").write_text("pmcid\n11\n")
    (tmp_path / "text.csv").write_text("pmcid,body\n")
    asked = []
    some = spark.createDataFrame([(str(k), k, True) for k in (15, 11, 13, 14)], "pmid string, pmcid long, retrieval_in_scope boolean")
    CsvFolderRetriever(str(tmp_path), lambda ids: asked.extend(r["pmcid"] for r in ids.collect()), 2).retrieve(conform(some))
    assert sorted(asked) == [13, 14]


def test_exports_are_streamed(spark, tmp_path):
    """Parts of many tasks in one file, in order; empty frames; a value of several lines; ties."""
    from pyspark.sql import functions as F

    from studyloom.operators import export
    from studyloom.sources import sinks

    many = spark.range(500, numPartitions=7).select((F.col("id") * 37 % 500).alias("k"), F.concat(F.lit('a,"b"\n'), F.col("id").cast("string")).alias("v"), (F.col("id") % 2 == 0).alias("even"))
    sinks.csv_file(many.orderBy("k"), str(tmp_path / "all.csv"))
    rows = list(csv.reader((tmp_path / "all.csv").open(newline="")))
    assert rows[0] == ["k", "v", "even"] and [int(r[0]) for r in rows[1:]] == list(range(500)) and {r[2] for r in rows[1:]} == {"True", "False"}
    sinks.csv_file(many.where("k < 0"), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text() == "k,v,even\n"

    sinks.lines(many.select(F.format_string("%03d", "k").alias("k")), "k", str(tmp_path / "all.txt"))
    assert (tmp_path / "all.txt").read_text().split() == [f"{k:03}" for k in range(500)]
    sinks.lines(many.where("k < 0"), "k", str(tmp_path / "none.txt"))
    assert (tmp_path / "none.txt").read_text() == ""

    for name, rows, as_list in (("all", many, False), ("list", many, True), ("none", many.where("k < 0"), True)):
        sinks.enclosed(rows, {"id": 'x"', "other": None}, "rows", str(tmp_path / f"{name}.json"), [F.col("k")], ["k", "v"], as_list)
        got = json.loads((tmp_path / f"{name}.json").read_text())
        got = got[0] if as_list else got
        assert (got["id"], got["other"], [r["k"] for r in got["rows"]]) == ('x"', None, [] if name == "none" else list(range(500)))

    notes = spark.createDataFrame([("b", True), ("a'", False), ("a", False), ("a", False)], "analysis_id string, m boolean")
    assert [(r["analysis"], r["note"]["m"]) for r in export.note_rows(notes, ["m"], "n").orderBy("analysis").collect()] == [("a", False)] * 3 + [("b", True)]
    sinks.by_table(spark.createDataFrame([("t2", '{"a":\n1}'), ("t1", None), ("t2", None)], "table_id string, payload string"), str(tmp_path))
    assert json.loads((tmp_path / "all_results.json").read_text()) == {"t1": None, "t2": {"a": 1}}


def test_table_functions(spark):
    """Null, empty and broken documents give no rows; positions run on; names may clash."""
    from studyloom import sql

    sql.register(spark)
    sql.register(spark)  # again: no error
    payload = '{"analyses": [{"name": "a", "points": [{"coordinates": [1, 2, 3], "values": [{"value": "n.s."}, {"value": "2.5"}]}, {"coordinates": [1, null, 3]}, {"coordinates": null}]}, {"name": null}]}'
    answers = spark.createDataFrame([(1, payload), (2, None), (3, ""), (4, "[1"), (5, '{"analyses": []}')], "pos int, payload string")
    got = spark.sql("SELECT a.pos AS k, p.* FROM {a} AS a, LATERAL parse_analyses(a.payload) AS p ORDER BY k, p.pos", a=answers).collect()
    assert [(r["k"], r["pos"], r["name"], len(r["points"])) for r in got] == [(1, 0, "a", 1), (1, 1, None, 0)]
    assert [(v["value_text"], v["value_num"]) for v in got[0]["points"][0]["values"]] == [("n.s.", None), ("2.5", 2.5)]

    payload = '{"decisions": [{"analysis_id": " a ", "annotations": [{"annotation_name": "m", "include": "YES"}, {"annotation_name": "n", "include": true}]}, {"analysis_id": "b", "annotations": [{"annotation_name": "m", "include": "so so"}]}, {"analysis_id": "c"}]}'
    answers = spark.createDataFrame([(1, payload), (2, None), (3, "x")], "k int, payload string")
    got = spark.sql("SELECT d.* FROM {a} AS a, LATERAL parse_decisions(a.payload) AS d ORDER BY pos", a=answers).collect()
    assert [tuple(r)[:4] for r in got] == [(0, "a", "m", True), (1, "a", "n", True), (100_000, "b", "m", None)]

    documents = spark.createDataFrame([(1, XML), (2, None), (3, "<broken"), (4, "")], "k int, xml string")
    got = spark.sql("SELECT d.k, r.* FROM {d} AS d, LATERAL shred_articles(d.xml) AS r", d=documents).orderBy("k", "pmid").collect()
    assert [(r["k"], r["pmid"], r["error"] is None) for r in got] == [(1, None, True), (1, "1", True), (3, None, False)]
    assert got[1]["title"] == "A " and [tuple(x) for x in got[1]["authors"]] == [("J", "Doe"), (None, None)]
    plan = spark.sql("SELECT p.name FROM {a} AS a, LATERAL parse_analyses(a.payload) AS p", a=answers)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Join" not in plan.split("== Physical Plan ==")[1]

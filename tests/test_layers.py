"""Cached files as a layer, quarantine, counters, the search service as a data source,
CSV sets, folders of tables."""

import json

import pytest
from pyspark.sql import functions as F

from studyloom import config as cfg
from studyloom.functions import status as st
from studyloom.operators import annotation, models
from studyloom.pipeline import Review, conform
from studyloom.sources import csv_sets, layers, sinks
from studyloom.sources.pubmed_source import PubMedSource, published
from studyloom.tables import parse_folder

TABLE = "struct<table_id:string,table_label:string,table_caption:string,table_foot:string,table_data_path:string,table_raw_path:string,raw_table:string>"


class Refusing(models.ModelClient):
    def respond(self, requests):
        rows = requests.select("task", "study_id").collect()
        assert not rows, f"asked again: {rows}"
        return requests.sparkSession.createDataFrame([], models.RESPONSES)


class Engine:
    def __init__(self, found):
        self.found, self.fetched = found, []

    def ids(self, _spark, _config):
        return self.found.select("pmid")

    def details(self, ids):
        self.fetched += [r["pmid"] for r in ids.collect()]
        return self.found.join(ids, "pmid", "left_semi")


def test_a_run_over_the_files_of_another(spark, tmp_path):
    found = spark.createDataFrame([("1", 0, "study one", "a study", [("t1", "T", "cap", None, None, None, "x,y,z")]), ("2", 1, "other", "nothing", None)], f"pmid string, pos long, title string, abstract string, activation_tables array<{TABLE}>").withColumn("status", F.lit(st.PENDING))
    given = {"search": {"query": "q"}, "screening": {k: {"objective": "find", "inclusion_criteria": ["memory"]} for k in ("abstract", "fulltext")}, "parsing": {"parse_coordinates": True}}
    texts = spark.createDataFrame([("1", "study text", "/1.txt")], "pmid string, body string, path string")
    make = lambda folder, client, caches=None: Review(spark, cfg.from_dict({**given, "output": {"directory": f"{tmp_path}/{folder}", "nimads": True}}), client, Engine(found), texts, caches=caches)
    first = make("first", models.RuleClient())
    first.run()
    assert first.tally() | {} == {"fetched": 2, "abstract included": 1, "abstract excluded": 1, "abstract failed": 0, "abstract incomplete": 0, "abstract screened": 2, "fulltext included": 1, "fulltext excluded": 0, "fulltext failed": 0, "fulltext incomplete": 0, "fulltext screened": 1, "parsed": 2, "points": 2, "decisions": 6}
    files = tmp_path / "first" / "outputs"
    # one record of the screening file is broken, and the search file has one without an id
    path = files / "abstract_screening_results.json"
    stored = json.loads(path.read_text())
    stored["screening_results"] += ["nonsense", {"reason": "no id"}, {"study_id": "9", "decision": "INCLUDED", "confidence": "much"}]
    path.write_text(json.dumps(stored))
    second = make("second", Refusing(), str(files))
    stats = second.run()
    assert second.search.fetched == [] and stats["included_studies"] == 1
    broken = second.table("broken_abstract_screening").orderBy("pos").collect()
    assert [(r["pos"], r["reason"]) for r in broken][:2] == [(2, "not of this form"), (3, "no study_id, decision")] and second.tally()["broken abstract screening"] == len(broken) == 3
    one, two = (json.loads((tmp_path / f / "outputs" / "nimads_studyset.json").read_text())["studies"] for f in ("first", "second"))
    assert one == two
    (files / "fulltext_screening_results.json").write_text("{ no json")
    rows, broken = layers.layer(spark, str(files), "fulltext_screening")
    assert rows.count() == 0 and [(r["pos"], r["reason"], r["record"]) for r in broken.collect()] == [(-1, "no list of records", "{ no json")]
    rows, broken = layers.layer(spark, f"{tmp_path}/nowhere", "annotations")
    assert rows.count() == 0 and broken.count() == 0


def test_own_rows_lie_above_cached_ones(spark):
    upper = spark.createDataFrame([("1", "own"), (None, "own")], "k string, v string")
    lower = spark.createDataFrame([("1", "cached"), ("2", "cached"), (None, "cached")], "k string, v string")
    assert {tuple(r) for r in layers.above(upper, lower, ["k"]).collect()} == {("1", "own"), (None, "own"), ("2", "cached")}
    assert layers.above(None, lower, ["k"]).count() == 3


def test_quarantine(spark, tmp_path):
    analysis = "struct<name:string,description:string,table_id:string,parsed:boolean,points:array<struct<coordinates:array<double>,space:string,values:array<struct<value_text:string,value_num:double,kind:string>>>>>"
    one = lambda *tables: [(f"a{k}", None, t, False, []) for k, t in enumerate(tables)]
    have = lambda *ids: [(t, "", "", "", None, None, "x") for t in ids]
    rows = conform(spark.createDataFrame([("1", "t", st.INCLUDED_FULLTEXT, one("t1", None), have("t1")), ("2", "t", st.INCLUDED_FULLTEXT, one("t1", "t9"), have("t1")), ("3", "t", st.INCLUDED_FULLTEXT, one("t1"), None)], f"pmid string, title string, status string, analyses array<{analysis}>, activation_tables array<{TABLE}>"))
    assert {tuple(r) for r in annotation.quarantine(rows).collect()} == {("2", "2_analysis_1", "t9", "unknown table"), ("3", "3_analysis_0", "t1", "no tables")}
    asked = []

    class Client(models.ModelClient):
        def respond(self, requests):
            asked.extend(r["study_id"] for r in requests.collect())
            payload = json.dumps({"decisions": [{"analysis_id": f"1_analysis_{k}", "annotations": [{"annotation_name": "m", "include": True}]} for k in range(2)]})
            return requests.select("task", "study_id", "item_id", F.lit(1).alias("attempt"), F.lit(payload).alias("payload"))

    config = cfg.from_dict({"search": {"query": "q"}, "screening": {k: {"objective": "o", "inclusion_criteria": ["i"]} for k in ("abstract", "fulltext")}, "annotation": {"annotations": [{"name": "m"}]}, "output": {"directory": str(tmp_path)}})
    review = Review(spark, config, Client(), lambda _s, _c: rows)
    assert {r["analysis_id"] for r in review.custom_decisions(rows).collect()} == {"1_analysis_0", "1_analysis_1"} and asked == ["1"]
    assert review.table("quarantine").count() == 2 and review.tally()["quarantined"] == 2


def test_search_service_as_a_data_source(spark, tmp_path):
    log = str(tmp_path / "log")

    def fetch(url, params):
        with open(log, "a") as f:
            f.write(json.dumps([url.rsplit("/", 1)[1], params]) + "\n")
        if "esearch" in url:
            return json.dumps({"esearchresult": {"idlist": [str(k) for k in range(250, 0, -1)]}}).encode()
        one = "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><Journal><JournalIssue><PubDate><Year>20{1:02d}</Year><Month>Mar</Month></PubDate></JournalIssue></Journal><ArticleTitle>T{0}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
        return f"<S>{''.join(one.format(p, int(p) % 30) for p in params['id'].split(','))}</S>".encode()

    class Fake(PubMedSource):
        pass

    Fake.fetch = staticmethod(fetch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Fake)
    read = lambda: spark.read.format("studyloom_pubmed").option("term", "memory").option("ids_a_partition", 100).load()
    df = read().where("published >= '2010/01' and published <= '2020/12'").select("pmid", "rank", "published", "title")
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "2010/01" in plan and "published" in plan
    rows = df.collect()
    assert {r["pmid"] for r in rows} == {str(k) for k in range(1, 251) if 10 <= k % 30 <= 20} and all(r["rank"] == 250 - int(r["pmid"]) and r["title"] == f"T{r['pmid']}" for r in rows)
    calls = [json.loads(x) for x in open(log)]
    searches = [c for c in calls if c[0] == "esearch.fcgi"]
    assert {c[1]["term"] for c in searches} == {'memory AND ("2010/01"[Date - Publication] : "2020/12"[Date - Publication])'}
    fetches = [c[1]["id"].split(",") for c in calls if c[0] == "efetch.fcgi"]
    assert sorted(map(len, fetches)) == [50, 100, 100]
    with pytest.raises(Exception, match="option term"):
        spark.read.format("studyloom_pubmed").load().count()
    assert [published(*x) for x in (("2020", "Mar", "5"), ("2020", "12", None), ("2020", "Spring", "5"), (None, "Mar", "1"))] == ["2020/03/05", "2020/12", "2020", None]


def test_csv_sets_change_together(spark, tmp_path, monkeypatch):
    old, new = tmp_path / "old", tmp_path / "new"
    for folder in (old, new):
        folder.mkdir()
    (old / "metadata.csv").write_text("pmcid,title\n1,a\n2,b\n,kept\n")
    (old / "text.csv").write_text('pmcid,body\n1,"one\nmore"\n2,two\n')
    (new / "metadata.csv").write_text("pmcid,title,extra\n2,new,x\n3,c,y\n,added,z\n")
    (new / "text.csv").write_text("pmcid,body\n2,second\n")
    (new / "tables.csv").write_text("pmcid,table_id\n3,t\n")
    rows = lambda name: sorted(tuple(r)[:2] for r in csv_sets.read(spark, str(old), name).select("pmcid", F.col("title" if name == "metadata.csv" else "body")).fillna("-").collect())
    before = rows("metadata.csv"), rows("text.csv")
    whole, done = sinks.csv_file, []

    def crash(df, path):
        if done:
            raise OSError("disk full")
        done.append(path)
        whole(df, path)

    monkeypatch.setattr(sinks, "csv_file", crash)
    with pytest.raises(OSError):
        csv_sets.merge(spark, str(old), str(new))
    assert (rows("metadata.csv"), rows("text.csv")) == before and csv_sets.members(spark, str(old)) == ["metadata.csv", "text.csv"]
    monkeypatch.setattr(sinks, "csv_file", whole)
    csv_sets.merge(spark, str(old), str(new))
    assert rows("metadata.csv") == [("-", "added"), ("-", "kept"), ("1", "a"), ("2", "new"), ("3", "c")]
    assert rows("text.csv") == [("1", "one\nmore"), ("2", "second")] and csv_sets.members(spark, str(old)) == ["metadata.csv", "tables.csv", "text.csv"]
    csv_sets.merge(spark, str(old), str(new))
    assert rows("text.csv") == [("1", "one\nmore"), ("2", "second")]


def test_a_folder_of_tables(spark, tmp_path):
    folder, out = tmp_path / "csv", tmp_path / "out"
    folder.mkdir()
    for k in range(3):
        (folder / f"pmcid_{k}_t1.csv").write_text(f"x,y,z\n{k},2,3\n")
    (tmp_path / "info.csv").write_text("table_data_file,table_caption\ncsv/pmcid_1_t1.csv,a caption\n")
    asked = []

    class Client(models.ModelClient):
        def respond(self, requests):
            made = []
            for r in requests.collect():
                asked.append(r["study_id"])
                whole = {"analyses": [{"name": "n", "description": "a caption" in r["prompt"] and "c" or None, "points": [{"coordinates": [1.0, 2.0, 3.0], "space": "MNI"}]}]}
                made.append(("tables", r["study_id"], r["item_id"], 1, "{broken" if r["study_id"] == "pmcid_2_t1" else json.dumps(whole)))
            return requests.sparkSession.createDataFrame(made, models.RESPONSES)

    got = {(r["table_id"], r["name"], r["description"], len(r["points"])) for r in parse_folder(spark, str(folder), Client(), str(out), str(tmp_path / "info.csv")).collect()}
    assert got == {("pmcid_0_t1", "n", None, 1), ("pmcid_1_t1", "n", "c", 1)} and sorted(asked) == ["pmcid_0_t1", "pmcid_1_t1", "pmcid_2_t1"]
    stored = json.loads((out / "all_results.json").read_text())
    assert set(stored) == {f"pmcid_{k}_t1" for k in range(3)} and stored["pmcid_2_t1"] is None and stored["pmcid_0_t1"]["analyses"][0]["name"] == "n"
    parse_folder(spark, str(folder), Client(), str(out)).count()
    assert sorted(asked[3:]) == ["pmcid_1_t1"]  # its prompt has no caption now


def test_html_sources_and_repeated_bodies(spark, tmp_path):
    from studyloom.engines import CsvFolderRetriever, LocalRetriever

    texts, folder = tmp_path / "texts", tmp_path / "csv"
    texts.mkdir()
    folder.mkdir()
    (texts / "11.html").write_text("<html><script>x</script><nav><p>Menu of this long page, as ever</p></nav><p>A study of memory.</p></html>")
    (texts / "12.txt").write_text("<p>kept as it is</p>")
    local = LocalRetriever([{"root_path": str(texts), "allowed_extensions": [".html", ".txt"]}])
    assert {r["pmid"]: r["body"] for r in local.texts(spark).collect()} == {"11": "A study of memory.", "12": "<p>kept as it is</p>"}
    (folder / "metadata.csv").write_text("pmcid\n7\n")
    (folder / "text.csv").write_text("pmcid,body\n7,b study\n7,a study\n8.0,other\n,none\n")
    assert {r["pmcid"]: r["body"] for r in CsvFolderRetriever(str(folder)).texts(spark).collect()} == {7: "a study", 8: "other"}
    asked = []

    class Client(models.ModelClient):
        def respond(self, requests):
            rows = requests.collect()
            asked.extend((r["task"], r["study_id"], "a study" in (r["prompt"] or "") or r["task"] == "abstract") for r in rows)
            payload = json.dumps({"decision": "INCLUDED", "confidence": 0.9, "reason": "r", "fulltext_incomplete": "false"})
            return requests.select("task", "study_id", "item_id", F.lit(1).alias("attempt"), F.lit(payload).alias("payload"))

    found = spark.createDataFrame([("1", 0, "one", "abstract", 7)], "pmid string, pos long, title string, abstract string, pmcid long").withColumn("status", F.lit(st.PENDING))
    config = cfg.from_dict({"search": {"query": "q"}, "screening": {k: {"objective": "o", "inclusion_criteria": ["i"]} for k in ("abstract", "fulltext")}, "output": {"directory": str(tmp_path / "out")}})
    stats = Review(spark, config, Client(), lambda _s, _c: found, csv_folder=str(folder)).run("full")
    assert asked == [("abstract", "1", True), ("fulltext", "1", True)] and stats["included_studies"] == 1


def test_documents_are_streamed(spark, tmp_path):
    rows = [(k, "é \"q\"\n" + "x" * k, None if k % 2 else [k]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, t string, a array<int>").repartition(7)
    sinks.nested(df, "studies", f"{tmp_path}/a.json", ["k"])
    got = json.loads((tmp_path / "a.json").read_text())
    assert got["studies"] == [{"k": k, "t": t, "a": a} for k, t, a in rows] and len(got["timestamp"]) == 19
    sinks.nested(df.where("k < 0"), None, f"{tmp_path}/a.json", ["k"])
    assert json.loads((tmp_path / "a.json").read_text()) == []
    sinks.nested(df.where("k = 3"), None, f"{tmp_path}/a.json", ["k"], keep_nulls=False)
    assert json.loads((tmp_path / "a.json").read_text()) == [{"k": 3, "t": rows[3][1]}]
    assert [p.name for p in tmp_path.iterdir()] == ["a.json"]

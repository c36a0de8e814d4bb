"""Stage operators on the survey's fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from studyloom.functions import status as st
from studyloom.operators import annotation, cbma, export, models, relational, report, retrieval, screening


def test_missing_fulltexts_and_counts(spark):
    rows = [
        ("PMID_INCLUDED", st.INCLUDED_FULLTEXT, True, True, True, None, None, None),
        ("PMID_UNAVAILABLE_INCLUDED", st.INCLUDED_ABSTRACT, True, False, True, "pubget", None, None),
        ("PMID_UNAVAILABLE_EXCLUDED", st.EXCLUDED_ABSTRACT, True, False, False, "pubget", None, None),
        ("PMID_INCOMPLETE", st.FULLTEXT_INCOMPLETE, True, True, True, "/tmp/local_corpus", "/tmp/incomplete_fulltext.txt", None),
        ("X", st.FULLTEXT_INCOMPLETE, True, True, None, None, None, 12345),
    ]
    studies = spark.createDataFrame(rows, "pmid string, status string, retrieval_in_scope boolean, fulltext_available boolean, in_included_set boolean, full_text_source string, full_text_path string, pmcid long")
    got = [tuple(r) for r in report.missing_fulltexts(studies, "/o").collect()]
    assert got == [
        ("PMID_INCOMPLETE", "incomplete", "/tmp/local_corpus", "/tmp/incomplete_fulltext.txt", True),
        ("X", "incomplete", "", "/o/retrieval/pubget_data/text.csv [pmcid=12345]", False),
        ("PMID_UNAVAILABLE_EXCLUDED", "unavailable", "pubget", "", False),
        ("PMID_UNAVAILABLE_INCLUDED", "unavailable", "pubget", "", True),
    ]
    assert report.prisma_counts(studies).first().asDict() == {"total_identified": 5, "abstract_screened": 5, "abstract_excluded": 1, "fulltext_assessed": 3, "fulltext_excluded": 0, "fulltext_incomplete": 2, "final_included": 1}


def test_cache_split(spark):
    studies = spark.createDataFrame([(x,) for x in "abcde"], "pmid string")
    stored = spark.createDataFrame([("a", "INCLUDED", 0), ("a", "excluded", 1), ("b", "fulltext_incomplete", 2), ("c", "junk", 3), ("d", "included_abstract", 4)], "study_id string, decision string, pos long").withColumn("reason", F.lit("r")).withColumn("confidence", F.lit(1.0))
    cached, todo = screening.cache_split(studies, stored, "fulltext", force_incomplete=True)
    assert {(r["pmid"], r["cached_status"]) for r in cached.collect()} == {("a", st.EXCLUDED_FULLTEXT), ("d", st.INCLUDED_FULLTEXT)}
    assert {r["pmid"] for r in todo.collect()} == {"b", "c", "e"}


def test_replayed_screening(spark):
    stored = spark.createDataFrame(
        [("abstract", "1", None, 1, "{broken"), ("abstract", "1", None, 2, '{"decision":"INCLUDED","confidence":0.95,"reason":"ok"}'), ("abstract", "2", None, 1, '{"decision":"INCLUDED","confidence":0.85,"reason":"hm"}'), ("abstract", "3", None, 1, '{"decision":"MAYBE","confidence":0.5,"reason":"x"}')],
        "task string, study_id string, item_id string, attempt int, payload string",
    )
    studies = spark.createDataFrame([(x,) for x in "1234"], "pmid string")
    got = {r["study_id"]: r for r in models.screen(studies, models.ReplayClient(stored), "abstract", True, 0.9).collect()}
    assert {k: r["decision"] for k, r in got.items()} == {"1": st.INCLUDED_ABSTRACT, "2": st.EXCLUDED_ABSTRACT, "3": st.SCREENING_FAILED, "4": st.SCREENING_FAILED}
    assert got["2"]["reason"] == "Confidence 0.85 below threshold 0.9. hm" and got["3"]["confidence"] == 0.0


def decisions(spark, rows):
    return spark.createDataFrame(rows, "study_id string, analysis_id string, annotation_name string, include boolean, pos long")


def test_annotation_upsert_against_the_rule(spark):
    rng = random.Random(0)
    names = ["all_studies", "all_abstract", "all_analyses", "x", "y", "z"]
    draw = lambda n, start: [(str(rng.randint(0, 8)), f"a{rng.randint(0, 2)}", rng.choice(names), rng.random() < 0.5, start + k) for k in range(n)]
    old, new = draw(150, 0), draw(20, 1000)
    touched = {}
    for s, _, n, _, _ in new:
        touched.setdefault(s, set()).add(n)
    keep = [r for r in old if r[0] not in touched or not (r[2] in touched[r[0]] or (touched[r[0]] - set(annotation.SCOPES) and r[2] not in annotation.SCOPES))]
    want = {r[:3]: r[3] for r in keep + new}
    got = annotation.upsert(decisions(spark, old), decisions(spark, new)).collect()
    assert len(got) == len(want) and {(r["study_id"], r["analysis_id"], r["annotation_name"]): r["include"] for r in got} == want


def test_system_scopes_and_completeness(spark):
    rows = spark.createDataFrame([("1", st.EXCLUDED_ABSTRACT, "1_analysis_0"), ("2", st.INCLUDED_ABSTRACT, "2_analysis_0"), ("3", st.EXCLUDED_FULLTEXT, "3_analysis_0")], "pmid string, status string, analysis_id string")
    made = annotation.system_decisions(rows)
    counts = {r["annotation_name"]: r["count"] for r in made.groupBy("annotation_name").count().collect()}
    assert counts == {"all_studies": 3, "all_abstract": 2}
    done = annotation.complete(made.union(made.where("study_id = '1'")), rows.select(F.col("pmid").alias("study_id"), "analysis_id"))
    assert {(r["study_id"], r["annotation_name"]): r["complete"] for r in done.collect()}[("1", "all_studies")] is False


def test_criteria_and_coverage(spark):
    rows = spark.createDataFrame(
        [("1", "a", "n", True, "", ["I1"], []), ("2", "a", "n", True, "", [], []), ("3", "a", "n", True, "", ["I7"], []), ("4", "a", "n", False, "not I1", [], []), ("5", "a", "n", False, "no", [], []), ("6", "a", "free", True, "", ["bad"], [])],
        "study_id string, analysis_id string, annotation_name string, include boolean, reasoning string, inclusion_criteria_applied array<string>, exclusion_criteria_applied array<string>",
    )
    mapping = spark.createDataFrame([("n", ["I1"], ["E1"])], "annotation_name string, inclusion array<string>, exclusion array<string>")
    got = {r["study_id"]: r["criteria_error"] for r in annotation.criteria_errors(rows, mapping).collect()}
    assert got == {"1": None, "2": "inclusion without an id", "3": "unknown id", "4": None, "5": "exclusion without a reason", "6": "not an id"}
    cover = annotation.coverage(rows, ["n", "m"]).where("study_id = '1'").first()
    assert (cover["missing"], cover["extra"], cover["duplicates"]) == (["m"], [], False)


def test_payload(spark):
    good = '{"decisions":[{"analysis_id":" 1_analysis_0 ","annotations":[{"annotation_name":"n","include":"yes","reasoning":"r"},{"annotation_name":"m","include":false}]}]}'
    rows = spark.createDataFrame([("1", 1, good), ("2", 1, "{"), ("3", 1, '{"decisions":[{"analysis_id":"x","annotations":[{"annotation_name":"n"}]}]}')], "study_id string, attempt int, payload string")
    got = {(r["study_id"], r["annotation_name"]): (r["analysis_id"], r["include"], r["error"]) for r in annotation.parse_payload(rows).collect()}
    assert got == {("1", "n"): ("1_analysis_0", True, None), ("1", "m"): ("1_analysis_0", False, None), ("2", None): (None, None, "no analysis_id"), ("3", "n"): ("x", None, "no include")}


def test_group_and_attach(spark):
    rows = spark.createDataFrame([(1, "b", "L2", 2, 1.0, 2.0, 3.0), (1, "a", "L1", 0, 4.0, 5.0, 6.0), (1, "a", "L9", 1, 7.0, 8.0, 9.0), (None, "a", "x", 3, 0.0, 0.0, 0.0)], "pmcid long, table_id string, table_label string, row_pos long, x double, y double, z double")
    grouped = retrieval.group_coordinates(rows, "pmcid")
    got = {r["table_id"]: (r["analysis_pos"], r["description"], [p["coordinates"] for p in r["points"]]) for r in grouped.collect()}
    assert got == {"a": (0, "L1", [[4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]), "b": (1, "L2", [[1.0, 2.0, 3.0]])}
    studies = spark.createDataFrame([(1, "s"), (2, "t")], "pmcid long, pmid string")
    once = retrieval.attach(studies, grouped, "pmcid", "analyses", "analysis_pos", True)
    twice = retrieval.attach(once, grouped, "pmcid", "analyses", "analysis_pos", False)
    assert {r["pmid"]: [a["table_id"] for a in r["analyses"] or []] for r in twice.collect()} == {"s": ["a", "b", "a", "b"], "t": []}


def test_first_source_and_merges(spark):
    studies = spark.createDataFrame([("1",), ("2",), ("3",)], "pmid string")
    a, b = spark.createDataFrame([("1", "A")], "pmid string, path string"), spark.createDataFrame([("1", "B"), ("2", "B")], "pmid string, path string")
    assert {r["pmid"]: r["path"] for r in relational.first_source(studies, [a, b], "pmid").collect()} == {"1": "A", "2": "B", "3": None}
    old = spark.createDataFrame([(1, "o"), (1, "p"), (2, "o")], "pmcid int, v string")
    assert sorted(tuple(r) for r in retrieval.merge_csv(old, spark.createDataFrame([(1, "n")], "pmcid int, v string")).collect()) == [(1, "n"), (2, "o")]
    assert relational.in_ids(studies, None, "pmid").count() == 3 and relational.in_ids(studies, studies.limit(0), "pmid").count() == 0


def toy(spark):
    rows = [("c", "u1", 0.0, 0.0, 0.0), ("c", "u1", 4.0, 0.0, 0.0), ("c", "u2", 8.0, 4.0, 0.0), ("d", "u3", 0.0, 0.0, 0.0), ("d", "u3", float("nan"), 0.0, 0.0), ("d", "u3", 900.0, 0.0, 0.0)]
    return rows, spark.createDataFrame(rows, "column string, unit string, x double, y double, z double")


def brute(rows, step, radius):
    cells = []
    for column, unit, *p in rows:
        if all(abs(v) < 500 for v in p):
            cells.append((column, unit, tuple(round((v - o) / step) for v, o in zip(p, cbma.ORIGIN))))
    n = int(radius // step)
    near = {}
    for column, unit, c in cells:
        for d in itertools.product(range(-n, n + 1), repeat=3):
            d2 = sum(v * v for v in d) * step * step
            at = tuple(a + b for a, b in zip(c, d))
            if d2 <= radius * radius and all(0 <= v <= e // step for v, e in zip(at, cbma.EXTENT)):
                near.setdefault((column, at[0] * 1_000_000 + at[1] * 1000 + at[2]), []).append((unit, d2))
    return near


def test_estimators_against_brute_force(spark):
    import math

    rows, foci = toy(spark)
    near = brute(rows, 4, 10)
    wide = brute(rows, 4, 3 * 10 / (2 * math.sqrt(2 * math.log(2))))
    got = {(r["column"], r["voxel"]): r["stat"] for r in cbma.mkda(foci).collect()}
    assert got == {k: len({u for u, _ in v}) for k, v in near.items()}
    got = {(r["column"], r["voxel"]): r["stat"] for r in cbma.kda(foci).collect()}
    assert got == {k: len(v) for k, v in near.items()}
    sigma2 = (10 / (2 * math.sqrt(2 * math.log(2)))) ** 2
    top = 64 / (2 * math.pi * sigma2) ** 1.5
    got = {(r["column"], r["voxel"]): r["stat"] for r in cbma.ale(foci).collect()}
    assert set(got) == set(wide)
    for k, v in wide.items():
        keep = 1.0
        for u in {u for u, _ in v}:
            keep *= 1 - top * math.exp(-min(d for w, d in v if w == u) / (2 * sigma2))
        assert got[k] == pytest.approx(1 - keep)
    with pytest.raises(ValueError):
        cbma.estimate("other", foci)


def test_correctors_and_clusters(spark):
    tests = spark.createDataFrame([("c", p) for p in (0.01, 0.02, 0.02, 0.5)], "column string, p double")
    assert sorted(r["q"] for r in cbma.fdr(tests).collect()) == pytest.approx(sorted([0.04, 0.02 * 4 / 3, 0.02 * 4 / 3, 0.5])[:0] + [0.02 * 4 / 3, 0.02 * 4 / 3, 0.02 * 4 / 3, 0.5])
    assert sorted(r["q"] for r in cbma.bonferroni(tests).collect()) == pytest.approx([0.04, 0.08, 0.08, 1.0])
    line = [(k, 5, 5) for k in range(12)] + [(0, 9, 9), (0, 9, 10), (20, 0, 0)]
    voxels = spark.createDataFrame([("c", i * 1_000_000 + j * 1000 + k) for i, j, k in line], "column string, voxel long")
    got = {r["voxel"]: r["cluster"] for r in cbma.clusters(voxels).collect()}
    assert {got[i * 1_000_000 + j * 1000 + k] for i, j, k in line[:12]} == {5005} and got[9010] == 9009 and got[20_000_000] == 20_000_000
    _, foci = toy(spark)
    stats = cbma.mkda(foci)
    once, again = (sorted(tuple(r) for r in cbma.montecarlo(foci, stats, n_iters=3).collect()) for _ in range(2))
    assert once == again and all(0 < r[-1] <= 1 for r in once)


def test_p_values_of_each_estimator(spark):
    import math

    rng = random.Random(3)
    spot = [("c", f"u{k}", 2.0, 2.0, 2.0) for k in range(30)]
    rest = [("c", f"v{k}", *(float(rng.randint(o, o + e)) for o, e in zip(cbma.ORIGIN, cbma.EXTENT))) for k in range(30)]
    foci = spark.createDataFrame(spot + rest, "column string, unit string, x double, y double, z double")
    size = cbma.grid_size(4)
    stats = cbma.mkda(foci)
    filled, units = sum(r["stat"] for r in stats.collect()), 60
    p = filled / units / size
    for r in cbma.mkda_p(stats, foci).collect():
        want = sum(math.comb(units, k) * p**k * (1 - p) ** (units - k) for k in range(r["stat"], units + 1))
        assert r["p"] == pytest.approx(want)
    done = cbma.correct("fdr", foci, cbma.mkda_p(stats, foci)).collect()
    assert all((r["q"] < 0.05) == (r["stat"] > 3) for r in done if r["stat"] != 3)  # a voxel that one unit touches is not significant
    counts = cbma.kda(foci)
    mean = sum(r["stat"] for r in counts.collect()) / size
    for r in cbma.kda_p(counts, foci).collect():
        assert r["p"] == pytest.approx(1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(r["stat"])), abs=1e-12)
    scores = cbma.ale(foci)
    got = {round(r["stat"], 9): r["p"] for r in cbma.ale_p(scores, foci).collect()}
    few = foci.where("unit in ('v0', 'v1')")
    two = {r["stat"]: r["p"] for r in cbma.ale_p(cbma.ale(few), few).collect()}
    share = len(two) and max(two.values())
    assert 0 < min(two.values()) < share < 0.01 and all(a <= b for (_, b), (_, a) in itertools.pairwise(sorted(two.items())))
    assert max(got, key=got.get) < 0.02 and got[max(got)] == pytest.approx(1e-15, abs=1e-9)
    drawn = {r["stat"]: r["q"] for r in cbma.correct("montecarlo", foci, scores, estimator="ale", n_iters=50).collect()}
    assert drawn[max(drawn)] == pytest.approx(1 / 51) and drawn[min(drawn)] == 1
    with pytest.raises(TypeError):
        cbma.estimate("ale", foci, kernel__r=3)


def test_export(spark):
    schema = "pmid string, pos long, doi string, title string, abstract string, journal string, authors array<string>, publication_date string, coordinate_space string, status string, analyses array<struct<name:string,description:string,table_id:string,parsed:boolean,points:array<struct<coordinates:array<double>,space:string,values:array<struct<value_text:string,value_num:double,kind:string>>>>>>"
    rows = [("100", 0, None, "t", "a", "j", ["A B"], "2023-01-01", "TAL", st.INCLUDED_FULLTEXT, [(" 'x' ", None, "t1", True, [([1.5, 2.5, -0.5], None, [("3.1", 3.1, "t-statistic")])])]), ("200", 1, None, "t", "a", "j", [], "2023", None, st.EXCLUDED_FULLTEXT, [("y", None, None, False, None)]), ("300", 2, None, "t", "a", "j", [], "", None, st.INCLUDED_FULLTEXT, [])]
    studies = spark.createDataFrame(rows, schema)
    doc = export.nimads_studyset(export.exportable(studies), "id").first()
    (study,) = doc["studies"]
    (analysis,) = study["analyses"]
    (point,) = analysis["points"]
    assert (study["id"], study["year"], study["authors"], analysis["id"], analysis["name"]) == ("100", 2023, "A B", "100_analysis_0", "x")
    assert (point["id"], point["coordinates"], point["space"], point["values"][0]["value"]) == ("100_analysis_0_point_0", [2, 2, 0], "TAL", "3.1")
    marks = decisions(spark, [("100", "100_analysis_0", "risky_dm", True, 0), ("200", "200_analysis_0", "risky_dm", True, 1)])
    notes = annotation.notes(marks, annotation.explode_analyses(export.exportable(studies)).select("analysis_id"), ["risky_dm"])
    note = export.nimads_annotation(notes, ["risky_dm"], "ann", "id", "n").first()
    assert [(n["analysis"], n["note"]) for n in note["notes"]] == [("100_analysis_0", {"risky_dm": True})] and note["note_keys"] == {"risky_dm": "boolean"}

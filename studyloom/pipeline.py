"""The review pipeline: stages over one studies relation.

Every stage is a function of DataFrames. Between stages the relation is written
as a new Parquet version in the output folder, which is what later stages, later
runs and lost executors read.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from studyloom import config as cfg
from studyloom import schemas
from studyloom.engines import CsvFolderRetriever, LocalRetriever, SearchEngine
from studyloom.functions import prompts
from studyloom.functions import status as st
from studyloom.meta import run_meta  # noqa: F401  also found here
from studyloom.operators import annotation, export, models, relational, report, retrieval, screening
from studyloom.sources import files, layers, sinks
from studyloom.streaming.journal import Journal

STAGES = ("search", "abstract", "retrieval", "full", "parsing", "annotation", "output")
#: Stages that a run may be told to stop after.
CUTS = ("search", "abstract", "full")


def conform(studies: DataFrame) -> DataFrame:
    """All columns of the studies relation, typed; absent ones null."""
    return studies.select(*[(F.col(f.name) if f.name in studies.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.STUDY.fields])


class Review:
    """One run: ``search``, an engine or a function, gives the studies; ``client``
    answers for the model. ``csv_folder`` is what a download tool leaves, by pmcid;
    ``download`` is given the pmcids that it lacks. ``caches`` is a folder of JSON files
    of an earlier run, of this or another tool: what they hold is neither fetched nor
    asked for."""

    def __init__(self, spark: SparkSession, config: cfg.PipelineConfig, client: models.ModelClient, search: SearchEngine | Callable[[SparkSession, cfg.SearchConfig], DataFrame], fulltexts: DataFrame | None = None, force_incomplete: bool = False, csv_folder: str | None = None, download: Callable[[DataFrame], None] | None = None, caches: str | None = None):
        self.spark, self.config, self.client, self.search, self.fulltexts = spark, config, client, search, fulltexts
        self.csv_folder, self.download, self.caches = csv_folder, download, caches
        self.counts: dict[str, dict[str, int]] = {}
        self.force_incomplete = force_incomplete
        self.root = config.output.directory.rstrip("/")
        self.errors: list[str] = []
        self.stats: dict[str, float | str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/outputs/{name}"

    def table(self, name: str) -> DataFrame | None:
        p = self.path(f"tables/{name}")
        return self.spark.read.parquet(p) if sinks.recover(self.spark, p) else None

    def save(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """Write a table. Its rows, and ``counts`` of them, are counted as they are
        written, without a scan of their own."""
        seen = Observation(f"saved_{name}")
        sinks.new_version(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in counts.items()]), self.path(f"tables/{name}"))
        self.counts[name] = {"rows": 0, **{k: v or 0 for k, v in seen.get.items()}}
        return self.spark.read.parquet(self.path(f"tables/{name}"))

    def stored(self, name: str) -> DataFrame | None:
        """The run's own table above the layer of cached files; records of these that
        can't be read are the table ``broken_<name>``."""
        own = self.table(name)
        if self.caches is None:
            return own
        rows, broken = layers.layer(self.spark, self.caches, name)
        self.save(broken, f"broken_{name}")
        return self.save(layers.above(own, rows, layers.LAYERS[name][-1]), f"layered_{name}")

    def journal(self, name: str) -> Journal:
        """Answers of the model for a stage, kept as they come."""
        return Journal(self.spark, self.path(f"journal/{name}"))

    def bodies(self) -> DataFrame:
        """(pmid, body): one text of each study, of several the first by text."""
        if self.fulltexts is None:
            return self.spark.createDataFrame([], "pmid string, body string")
        return self.fulltexts.groupBy("pmid").agg(F.min("body").alias("body"))

    # --- stages

    def run_search(self) -> DataFrame:
        cached = self.stored("search")
        if hasattr(self.search, "details"):  # details of new ids only
            ids = self.search.ids(self.spark, self.config.search)
            found = conform(self.search.details(ids if cached is None else relational.new_ids(ids, cached)))
        else:
            found = conform(getattr(self.search, "search", self.search)(self.spark, self.config.search))
            found = found if cached is None else relational.new_ids(found, cached)
        found = self.save(found, "found")
        return self.save(found if cached is None else conform(cached).unionByName(found), "search")

    def run_screening(self, studies: DataFrame, stage: str) -> DataFrame:
        settings = getattr(self.config.screening, "abstract" if stage == "abstract" else "fulltext")
        if settings.get("skip_stage"):
            return screening.skip_stage(studies, stage)
        todo = screening.with_abstract(screening.pending(studies)) if stage == "abstract" else screening.ready_for_fulltext(studies)
        stored = self.stored(f"{stage}_screening")
        cached = None
        if stored is not None:
            cached, todo = screening.cache_split(todo, stored, stage, self.force_incomplete)
        body = None
        if stage == "fulltext":
            todo = todo.join(self.bodies(), "pmid", "left")
            body = F.col("body")
        prompt = prompts.screening(settings, stage, F.col("title"), F.col("abstract"), F.col("authors"), F.col("journal"), body)
        new = models.screen(todo.select("pmid", prompt.alias("prompt")), self.client, stage, bool(settings.get("confidence_reporting")), settings.get("threshold"), settings.get("model") or "", self.journal(f"{stage}_screening"))
        new = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.SCREENING.fields])
        if cached is not None:
            old = cached.select(F.col("pmid").alias("study_id"), F.col("cached_status").alias("decision"), F.col("cached_reason").alias("reason"), F.col("cached_confidence").alias("confidence"), F.lit(stage).alias("screening_type"))
            new = old.unionByName(new, allowMissingColumns=True)
        kinds = {"included": F.count_if(F.col("decision").startswith("included")), "excluded": F.count_if(F.col("decision").startswith("excluded")), "failed": F.count_if(F.col("decision").endswith("failed")), "incomplete": F.count_if(F.col("decision").endswith("incomplete"))}
        results = self.save(new, f"{stage}_screening", **kinds)
        out = screening.apply_results(studies, results, stage)
        done = results.select("study_id").distinct().withColumn("_done", F.lit(True))
        return conform(out.join(done, out["pmid"] == done["study_id"], "left").withColumn("screened_at", F.when(F.col("_done"), F.current_timestamp()).otherwise(F.col("screened_at"))))

    def run_retrieval(self, studies: DataFrame) -> DataFrame:
        rows = retrieval.in_scope(studies, self.config.retrieval.load_excluded)
        if self.config.retrieval.full_text_sources and self.fulltexts is None:
            local = LocalRetriever(self.config.retrieval.full_text_sources)
            self.fulltexts = self.save(local.texts(self.spark), "fulltexts")
            rows = local.retrieve(conform(rows), self.fulltexts)
            if (points := local.points(self.spark)) is not None:
                # a study takes what the source of its text has
                mine = [x.join(self.fulltexts.select("pmid", "source_pos"), ["pmid", "source_pos"], "left_semi").drop("source_pos") for x in points]
                rows = retrieval.attach(rows, mine[0], "pmid", "analyses", "place", True)
                rows = retrieval.attach(rows, mine[1], "pmid", "activation_tables", "place", True)
        elif self.fulltexts is not None:
            rows = self.given_texts(rows)
        return conform(self.remote_texts(conform(rows)))

    def remote_texts(self, rows: DataFrame) -> DataFrame:
        """PMCIDs of the studies in scope without a text, then the texts, coordinates and
        tables that the CSV folder has for them."""
        lacking = F.coalesce("retrieval_in_scope", F.lit(False)) & ~F.coalesce("fulltext_available", F.lit(False))
        if hasattr(self.search, "pmcids"):
            need = rows.where(lacking & F.col("pmcid").isNull()).select("pmid")
            rows = relational.lookup(rows, self.save(self.search.pmcids(need), "pmcids"), "pmid", "pmcid")
        if self.csv_folder is None:
            return rows
        rows = self.save(conform(rows), "studies_with_pmcids")
        folder = CsvFolderRetriever(self.csv_folder, self.download)
        got = conform(folder.retrieve(rows.where(lacking)))
        bodies = rows.where(lacking).select("pmid", "pmcid").join(folder.texts(self.spark), "pmcid").select("pmid", "body")
        self.fulltexts = self.save(bodies if self.fulltexts is None else self.fulltexts.select("pmid", "body").unionByName(bodies), "all_fulltexts")
        return rows.where(~lacking).unionByName(got)

    def given_texts(self, rows: DataFrame) -> DataFrame:
        have = self.fulltexts.where("body is not null").groupBy("pmid").agg(F.first("path").alias("_path") if "path" in self.fulltexts.columns else F.lit(None).cast("string").alias("_path"))
        joined = rows.join(have.withColumn("_got", F.lit(True)), "pmid", "left")
        got = F.col("_got") & F.col("retrieval_in_scope")
        return (
            joined.withColumn("fulltext_available", F.coalesce(got, F.lit(False)) | F.coalesce("fulltext_available", F.lit(False)))
            .withColumn("full_text_path", F.coalesce("full_text_path", F.when(got, F.col("_path"))))
            .withColumn("full_text_source", F.coalesce("full_text_source", F.when(got, F.lit("full_text_source_1"))))
            .withColumn("retrieved_at", F.coalesce("retrieved_at", F.when(got, F.current_timestamp())))
        )

    def run_parsing(self, studies: DataFrame) -> DataFrame:
        if self.caches is not None:
            studies = conform(files.with_cached_analyses(studies, self.stored("coordinates")))
        if not self.config.parsing.parse_coordinates:
            return studies
        parsed = F.coalesce(F.exists("analyses", lambda a: F.coalesce(a["parsed"], F.lit(False))), F.lit(False))
        todo = studies.where((F.col("status") == st.INCLUDED_FULLTEXT) & F.coalesce(F.size("activation_tables") > 0, F.lit(False)) & ~parsed)
        tables = todo.select("pmid", F.posexplode("activation_tables").alias("table_pos", "t")).select("pmid", "table_pos", F.col("t.table_id").alias("table_id"), prompts.table(F.col("t.table_caption"), F.col("t.table_foot"), F.col("t.raw_table")).alias("raw_table"))
        made = models.parse_tables(tables, self.client, self.save, self.journal("tables")).withColumn("order", F.col("table_pos") * 100_000 + F.col("pos"))
        rows = self.save(made.select("pmid", "order", "name", "description", "table_id", "parsed", "points"), "parsed_analyses", points=F.sum(F.size("points")))
        cleared = studies.join(todo.select("pmid", F.lit(True).alias("_todo")), "pmid", "left")
        empty = F.array().cast(schemas.STUDY["analyses"].dataType)
        cleared = cleared.withColumn("analyses", F.when(F.col("_todo"), empty).otherwise(F.col("analyses"))).drop("_todo")
        return conform(retrieval.attach(cleared, rows, "pmid", "analyses", "order", False))

    def run_annotation(self, studies: DataFrame) -> DataFrame:
        """Decisions of the system annotations and of the configured ones."""
        settings = self.config.annotation
        rows = annotation.explode_analyses(studies)
        new = annotation.system_decisions(rows.select("pmid", "status", "analysis_id")) if settings.create_all_included_annotations else None
        old = self.stored("annotations")
        if settings.annotations:
            own = self.custom_decisions(studies, old)
            new = own if new is None else new.unionByName(own, allowMissingColumns=True)
        if new is None:
            return old if old is not None else self.save(self.spark.createDataFrame([], schemas.DECISION).withColumn("pos", F.lit(0).cast("long")), "annotations")
        full = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.DECISION.fields], (F.coalesce("pos", F.lit(0)) if "pos" in new.columns else F.lit(0)).cast("long").alias("pos"))
        return self.save(annotation.upsert(old, full, strict=True) if old is not None else full, "annotations")

    def custom_decisions(self, studies: DataFrame, old: DataFrame | None = None) -> DataFrame:
        """Decisions of the model about the studies that ``old`` does not have whole.
        Studies with an analysis of a table that they lack are left out; their analyses
        are the table ``quarantine``. Payloads that don't hold are asked for again; what is still wrong after that
        is left out."""
        settings = self.config.annotation
        rules = [vars(r) for r in cfg.injected_criteria(self.config)]
        names = [r["name"] for r in rules]
        exported = export.exportable(studies)
        apart = self.save(annotation.quarantine(exported), "quarantine")
        sound = exported.join(apart.select(F.col("study_id").alias("pmid")).distinct(), "pmid", "left_anti")
        included = self.save(annotation.unfinished(sound, old, names), "to_annotate")
        joined = included.join(self.bodies(), "pmid", "left")
        own = lambda a: F.get(F.filter("activation_tables", lambda t: t["table_id"] == a["table_id"]), F.lit(0))
        items = F.transform("analyses", lambda a, i: F.struct(F.concat(F.col("pmid"), F.lit("_analysis_"), i.cast("string")).alias("id"), a["name"].alias("name"), a["description"].alias("description"), a["table_id"].alias("table_id"), F.coalesce(own(a)["table_caption"], a["table_id"]).alias("table_caption"), own(a)["table_foot"].alias("table_foot")))
        single = settings.prompt_type == "single_analysis"
        if single:
            one = joined.select("pmid", "title", "abstract", "authors", "journal", "publication_date", "body", F.explode(items).alias("a"))
            about = F.struct(
                F.col("a.name").alias("analysis_name"), F.col("a.description").alias("analysis_description"), F.col("a.table_caption").alias("table_caption"), F.col("a.table_foot").alias("table_footer"),
                F.col("title").alias("study_title"), F.col("abstract").alias("study_abstract"), F.array_join("authors", ", ").alias("study_authors"), F.col("journal").alias("study_journal"),
                F.col("publication_date").alias("study_publication_date"), F.col("body").alias("study_fulltext"),
            )
            asked = one.select(F.lit("annotation_single").alias("task"), F.col("pmid").alias("study_id"), F.col("a.id").alias("item_id"), prompts.single_analysis(about, settings.metadata_fields, rules).alias("prompt"))
        else:
            group = F.struct(F.col("title"), F.col("abstract"), F.col("body").alias("fulltext"), items.alias("analyses"))
            asked = joined.select(F.lit("annotation").alias("task"), F.col("pmid").alias("study_id"), F.lit(None).cast("string").alias("item_id"), prompts.annotation(group, settings.metadata_fields, rules).alias("prompt"))
        shape = lambda got: annotation.single_payloads(got, names) if single else got
        known = annotation.explode_analyses(included).select(F.col("pmid").alias("study_id"), "analysis_id")
        mapping = [(r["name"], list((r.get("criteria_mapping") or {}).get("inclusion") or {}), list((r.get("criteria_mapping") or {}).get("exclusion") or {})) for r in rules]
        cited = self.spark.createDataFrame(mapping, "annotation_name string, inclusion array<string>, exclusion array<string>")
        answers = models.ask(self.client, asked, self.save, "annotation_responses", lambda got: annotation.bad_payloads(shape(got), known, names, cited), journal=self.journal("annotation"))
        parsed = annotation.parse_payload(shape(answers)).where("error is null")
        valid = parsed.where(F.col("annotation_name").isin(names)).join(known, ["study_id", "analysis_id"], "left_semi")
        return valid.drop("attempt", "error").withColumn("model_used", F.lit(settings.model))

    def run_output(self, studies: DataFrame, decisions: DataFrame | None) -> dict:
        counts = report.prisma_counts(studies).first().asDict()
        sinks.json_row(report.prisma_counts(studies), self.path("prisma_counts.json"))
        final = studies.where(F.col("status") == st.INCLUDED_FULLTEXT)
        sinks.nested(final.drop("pos").withColumn("pos", F.coalesce("pmid", F.lit(""))), "studies", self.path("final_results.json"), ["pos"])
        missing = report.missing_fulltexts(studies, self.root)
        sinks.csv_file(missing, self.path("missing_fulltexts.csv"))
        sinks.lines(missing.select("pmid"), "pmid", self.path("missing_fulltexts.txt"))
        self.export_tables(studies, decisions)
        if self.config.output.nimads:
            rows = export.exportable(studies, self.config.output.export_excluded_studies)
            set_id = time.strftime("%Y%m%d_%H%M%S")
            flat = export.nimads_studies(rows).select("pos", "study.*")
            sinks.enclosed(flat, export.studyset_facts(set_id), "studies", self.path("nimads_studyset.json"), [F.col("pos"), F.col("id")], flat.columns[1:])
            analyses = annotation.explode_analyses(rows).select("analysis_id")
            names = [r["annotation_name"] for r in decisions.select("annotation_name").distinct().orderBy("annotation_name").collect()] if decisions is not None else []
            if names:  # annotation names come from the configuration: a handful
                self.write_notes(annotation.notes(decisions, analyses, names), names, set_id, "annotations")
            else:
                self.write_notes(export.default_notes(rows), ["all_analyses"], set_id, "replication_annotations", as_list=True)
        return counts

    def write_notes(self, notes: DataFrame, names: list[str], set_id: str, name: str, as_list: bool = False) -> None:
        rows = export.note_rows(notes, names, "annotations")
        facts = export.annotation_facts(names, "annotations", set_id, name)
        sinks.enclosed(rows, facts, "notes", self.path("nimads_annotation.json"), [F.col("analysis"), F.to_json("note")], rows.columns, as_list)

    def export_tables(self, studies: DataFrame, decisions: DataFrame | None) -> None:
        """JSON forms of the working tables, for people and other tools."""
        sinks.nested(conform(self.table("search")).select("pmid", "title", "abstract", "authors", "journal", "publication_date", "doi", "keywords", "status", "pmcid"), "studies", self.path("search_results.json"), ["pmid"])
        for stage in ("abstract", "fulltext"):
            results = self.table(f"{stage}_screening")
            if results is not None:
                sinks.nested(results, "screening_results", self.path(f"{stage}_screening_results.json"), ["study_id"])
        sinks.nested(retrieval.report(studies), "studies", self.path("fulltext_retrieval_results.json"), ["pmid"])
        parsed = studies.where((F.col("status") == st.INCLUDED_FULLTEXT) & F.coalesce(F.size("analyses") > 0, F.lit(False))).select("pmid", "analyses")
        if not parsed.isEmpty():
            sinks.nested(parsed, "studies", self.path("coordinate_parsing_results.json"), ["pmid"])
        if decisions is not None:
            sinks.nested(decisions.drop("pos"), None, self.path("annotation_results.json"), annotation.KEY)

    def run(self, stop_after: str | None = None) -> dict:
        """Counts of the run. ``stop_after`` is search, abstract or full."""
        cut = stop_after.strip().lower() if stop_after else None
        if cut is not None and cut not in CUTS:
            raise ValueError(f"stop_after must be one of {', '.join(CUTS)}")
        begun = time.time()
        try:
            sinks.document(self.spark.createDataFrame([(json.dumps(cfg.criteria_mapping(self.config)),)], "value string"), self.path("criteria_mapping.json"))
            studies = self.run_search()
            if cut == "search":
                return self.finish(studies, begun)
            studies = self.save(self.run_screening(studies, "abstract"), "studies_abstract")
            if cut == "abstract":
                return self.finish(studies, begun)
            studies = self.save(self.run_retrieval(studies), "studies_retrieved")
            studies = self.save(self.run_screening(studies, "fulltext"), "studies_fulltext")
            if cut == "full":
                return self.finish(studies, begun)
            studies = self.save(self.run_parsing(studies), "studies")
            decisions = self.run_annotation(studies) if self.config.annotation.enabled else None
            self.run_output(studies, decisions)
            return self.finish(studies, begun)
        except Exception as e:
            self.errors.append(str(e))
            raise

    def finish(self, studies: DataFrame, begun: float) -> dict:
        self.stats = {**report.run_statistics(studies).first().asDict(), "seconds": round(time.time() - begun, 3)}
        return self.stats

    def tally(self) -> dict[str, int]:
        """What the run has counted while it wrote: fetched studies, screened ones by
        outcome, analyses and points that were parsed, decisions, quarantined analyses and
        broken records. What a run did not come to is not listed."""
        of = {"found": "fetched", "parsed_analyses": "parsed", "annotations": "decisions", "quarantine": "quarantined"}
        out = {}
        for name, counts in self.counts.items():
            if name in of:
                out[of[name]] = counts["rows"]
            elif name.startswith("broken_"):
                out[name.replace("_", " ")] = counts["rows"]
            if name.endswith("_screening") and "included" in counts:
                out |= {f"{name.removesuffix('_screening')} {k}": v for k, v in counts.items() if k != "rows"} | {f"{name.removesuffix('_screening')} screened": counts["rows"]}
            if name == "parsed_analyses":
                out["points"] = counts["points"]
        return out

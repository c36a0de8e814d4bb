"""Command line: run, run-search, run-abstract, validate, create-sample-config, meta."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from studyloom import config as cfg


def output_folder(config: str, given: str | None) -> str:
    """The given folder, else the configuration's path without its suffix."""
    return given or str(Path(config).with_suffix(""))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="studyloom", description="Evidence synthesis on Spark")
    sub = top.add_subparsers(dest="command", required=True)
    for name, what in (("run", "run the whole pipeline"), ("run-search", "stop after the search"), ("run-abstract", "stop after abstract screening")):
        p = sub.add_parser(name, help=what)
        p.add_argument("config")
        p.add_argument("output_folder", nargs="?")
        p.add_argument("--dry-run", action="store_true", help="validate only")
        p.add_argument("--verbose", "-v", action="store_true")
        p.add_argument("--debug", action="store_true")
        p.add_argument("--num-workers", "-j", type=int, default=1, help="partitions of model requests")
        p.add_argument("--requests-at-once", type=int, default=1, help="model requests on their way from a partition")
        p.add_argument("--requests-a-minute", type=float, help="most model requests a minute, of all partitions")
        p.add_argument("--tokens-a-minute", type=float, help="most tokens a minute, of all partitions")
        p.add_argument("--force-reextract-incomplete-fulltext", action="store_true")
        p.add_argument("--responses", help="Parquet table of stored model responses")
        p.add_argument("--fulltexts", help="Parquet table (pmid, body) of full texts")
        p.add_argument("--csv-folder", help="folder of CSV files of texts, tables and coordinates by pmcid")
        p.add_argument("--caches", help="folder of JSON results of an earlier run, of this or another tool")
        p.add_argument("--studies", help="Parquet table of studies in place of the search service")
    p = sub.add_parser("validate", help="check a configuration")
    p.add_argument("config")
    p.add_argument("output_folder", nargs="?")
    p.add_argument("--debug", action="store_true")
    sub.add_parser("create-sample-config", help="print a sample configuration")
    p = sub.add_parser("meta", help="meta-analysis of an export")
    p.add_argument("output_folder")
    p.add_argument("--estimator", choices=["ale", "mkdadensity", "kda"], default="mkdadensity")
    p.add_argument("--estimator-args", default="{}")
    p.add_argument("--corrector", choices=["fdr", "montecarlo", "bonferroni"], default="fdr")
    p.add_argument("--corrector-args", default="{}")
    p.add_argument("--include-ids")
    p.add_argument("--run-reports", action="store_true", help="accepted; no reports are made")
    p.add_argument("--fail-fast", action="store_true", help="end at the first column that fails")
    p.add_argument("--debug", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "create-sample-config":
        print(cfg.SAMPLE, end="")
        return 0
    if a.command == "meta":
        try:
            options = json.loads(a.estimator_args), json.loads(a.corrector_args)
        except ValueError as e:
            print(f"bad JSON arguments: {e}", file=sys.stderr)
            return 1
        from studyloom.pipeline import run_meta
        from studyloom.session import get_session
        from studyloom.sources.files import include_ids

        spark = get_session()
        ids = include_ids(spark, a.include_ids) if a.include_ids else None
        try:
            made = run_meta(spark, a.output_folder, a.estimator, a.corrector, *options, ids, fail_fast=a.fail_fast)
        except (TypeError, ValueError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
        from studyloom.meta import Results, outputs_of

        for r in made.groupBy("column").count().orderBy("column").collect():  # a row a column
            print(f"{r['column']}: {r['count']} voxels")
        errors = Results(spark, outputs_of(a.output_folder)).errors().where((F.col("estimator") == a.estimator) & (F.col("corrector") == a.corrector))
        for r in errors.orderBy("column").collect():
            print(f"{r['column']}: {r['error']}", file=sys.stderr)
        return 0
    try:
        config = cfg.load(a.config)
    except cfg.ConfigurationError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    config.output.directory = output_folder(a.config, a.output_folder)
    if a.command == "validate" or a.dry_run:
        stages = {k: getattr(config.screening, k) for k in ("abstract", "fulltext")}
        counts = {k: (len(v.get("inclusion_criteria") or []), len(v.get("exclusion_criteria") or [])) for k, v in stages.items()}
        print(f"valid: {config.output.directory}; criteria " + ", ".join(f"{k} {i}+{e}" for k, (i, e) in counts.items()))
        return 0
    from studyloom.engines import PubMedSearch, StoredSearch
    from studyloom.operators.models import HttpClient, ReplayClient
    from studyloom.pipeline import Review
    from studyloom.session import get_session

    spark = get_session()

    engine = StoredSearch(a.studies) if a.studies else PubMedSearch(workers=a.num_workers)
    client = ReplayClient(spark.read.parquet(a.responses)) if a.responses else HttpClient({"abstract": config.screening.abstract.get("model"), "fulltext": config.screening.fulltext.get("model"), "tables": config.parsing.coordinate_model, "annotation": config.annotation.model}, workers=a.num_workers, at_once=a.requests_at_once, requests_a_minute=a.requests_a_minute, tokens_a_minute=a.tokens_a_minute)
    texts = spark.read.parquet(a.fulltexts) if a.fulltexts else None
    review = Review(spark, config, client, engine, texts, a.force_reextract_incomplete_fulltext, a.csv_folder, caches=a.caches)
    stats = review.run({"run": None, "run-search": "search", "run-abstract": "abstract"}[a.command])
    for name, n in {**stats, **review.tally()}.items():
        print(f"{name.replace('_', ' ')}: {n}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

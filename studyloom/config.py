"""Configuration of a review: driver-side records, YAML in and out, validation."""

from __future__ import annotations

import re
import warnings
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigurationError(ValueError):
    pass


def _stage() -> dict[str, Any]:
    return {"model": "gpt-4", "threshold": None, "confidence_reporting": False, "objective": None, "inclusion_criteria": None, "exclusion_criteria": None, "additional_instructions": None}


@dataclass
class SearchConfig:
    database: str = "pubmed"
    query: str = ""
    max_results: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    email: str | None = None
    pmids_file: str | None = None
    pmids_list: list[str] | None = None


@dataclass
class ScreeningConfig:
    abstract: dict[str, Any] = field(default_factory=_stage)
    fulltext: dict[str, Any] = field(default_factory=_stage)


@dataclass
class RetrievalConfig:
    sources: list[str] = field(default_factory=lambda: ["pubget", "ace"])
    timeout: int = 30
    max_retries: int = 3
    download_directory: str = "downloads"
    n_jobs: int = 1
    load_excluded: bool = False
    full_text_sources: list[dict[str, Any]] = field(default_factory=list)
    parse_coordinates: bool = False
    coordinate_model: str = "gpt-4o-mini"


@dataclass
class ParsingConfig:
    parse_coordinates: bool = False
    coordinate_model: str = "gpt-4o-mini"


@dataclass
class OutputConfig:
    directory: str = "results"
    prisma_diagram: bool = True
    formats: list[str] = field(default_factory=lambda: ["csv", "json"])
    nimads: bool = False
    export_excluded_studies: bool = False


@dataclass
class AnnotationCriteria:
    name: str
    description: str = ""
    inclusion_criteria: list[str] = field(default_factory=list)
    exclusion_criteria: list[str] = field(default_factory=list)
    criteria_mapping: dict[str, dict[str, str]] | None = None


@dataclass
class AnnotationConfig:
    model: str = "gpt-4o-mini"
    create_all_included_annotations: bool = True
    annotations: list[AnnotationCriteria] = field(default_factory=list)
    enabled: bool = True
    prompt_type: str = "multi_analysis"
    metadata_fields: list[str] = field(default_factory=lambda: ["analysis_name", "analysis_description", "table_caption", "study_title", "study_fulltext"])
    inclusion_criteria: list[str] = field(default_factory=list)
    exclusion_criteria: list[str] = field(default_factory=list)


@dataclass
class PipelineConfig:
    search: SearchConfig = field(default_factory=SearchConfig)
    screening: ScreeningConfig = field(default_factory=ScreeningConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    output: OutputConfig = field(default_factory=OutputConfig)
    parsing: ParsingConfig = field(default_factory=ParsingConfig)
    annotation: AnnotationConfig = field(default_factory=AnnotationConfig)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


class CriteriaIds:
    """Hands out I1, I2, ... and E1, E2, ...; numbers run on between calls."""

    def __init__(self):
        self.last = {"I": 0, "E": 0}

    def assign(self, inclusion: list[str] | None, exclusion: list[str] | None, prefix: str = "") -> dict[str, dict[str, str]]:
        def number(letter: str, items: list[str] | None) -> dict[str, str]:
            made = {}
            for text in items or []:
                self.last[letter] += 1
                made[f"{prefix}{letter}{self.last[letter]}"] = text
            return made

        return {"inclusion": number("I", inclusion), "exclusion": number("E", exclusion)}


def namespace(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").upper() or "ANNOTATION"


def criteria_mapping(config: PipelineConfig) -> dict[str, Any]:
    """All ids: the two screening stages share one sequence; the global annotation
    criteria and each annotation have their own, with a prefix."""
    a = config.annotation
    return {
        "screening": {"abstract": config.screening.abstract.get("criteria_mapping"), "fulltext": config.screening.fulltext.get("criteria_mapping")},
        "annotation": {"global": CriteriaIds().assign(a.inclusion_criteria, a.exclusion_criteria, "GLOBAL_"), "local": {x.name: CriteriaIds().assign(x.inclusion_criteria, x.exclusion_criteria, f"{namespace(x.name)}_") for x in a.annotations}},
    }


def injected_criteria(config: PipelineConfig) -> list[AnnotationCriteria]:
    """Annotations with their mapping, the global one merged in below the local one.
    An annotation without own criteria gets no mapping at all."""
    made = criteria_mapping(config)["annotation"]
    out = []
    for x in config.annotation.annotations:
        local = made["local"][x.name]
        mapping = {k: {**made["global"][k], **local[k]} for k in ("inclusion", "exclusion")} if local["inclusion"] or local["exclusion"] else None
        out.append(AnnotationCriteria(x.name, x.description, x.inclusion_criteria, x.exclusion_criteria, mapping))
    return out


# Keys that older files may have.
LEGACY_ANNOTATION_KEYS = ("create_all_included_annotation", "create_all_studies_annotations", "create_all_from_search_annotation")
SECTION_FIELDS = ["analysis_name", "analysis_description", "table_caption", "study_title"]


def _annotation(given: dict[str, Any]) -> AnnotationConfig:
    if not given:
        return AnnotationConfig()
    if old := [k for k in LEGACY_ANNOTATION_KEYS if k in given]:
        raise ConfigurationError(f"{', '.join(old)} is no longer known; use create_all_included_annotations")
    known = {f.name for f in fields(AnnotationConfig)}
    made = {k: v for k, v in given.items() if k in known and k != "annotations"}
    made.setdefault("metadata_fields", list(SECTION_FIELDS))
    return AnnotationConfig(annotations=[AnnotationCriteria(**x) for x in given.get("annotations") or []], **made)


def from_dict(given: dict[str, Any]) -> PipelineConfig:
    """Validated configuration; any error inside is a ConfigurationError."""
    try:
        retrieval = dict(given.get("retrieval") or {})
        one = retrieval.pop("full_text_source", None)
        if one is not None:
            retrieval.setdefault("full_text_sources", [one])
        known = {f.name for f in fields(RetrievalConfig)}
        config = PipelineConfig(
            SearchConfig(**(given.get("search") or {})), ScreeningConfig(), RetrievalConfig(**{k: v for k, v in retrieval.items() if k in known}),
            OutputConfig(**(given.get("output") or {})), ParsingConfig(**(given.get("parsing") or {})), _annotation(given.get("annotation") or {}),
        )
        screening = given.get("screening") or {}
        config.screening.abstract.update(screening.get("abstract") or {})
        config.screening.fulltext.update(screening.get("fulltext") or {})
        ids = CriteriaIds()
        for stage in (config.screening.abstract, config.screening.fulltext):
            stage["criteria_mapping"] = ids.assign(stage.get("inclusion_criteria"), stage.get("exclusion_criteria"))
        validate(config)
        return config
    except ConfigurationError:
        raise
    except Exception as e:
        raise ConfigurationError(f"bad configuration: {e}") from e


def validate(config: PipelineConfig) -> None:
    def need(ok: bool, message: str) -> None:
        if not ok:
            raise ConfigurationError(message)

    s = config.search
    need(bool(s.pmids_file or s.pmids_list or s.query.strip()), "search needs a query or pmids")
    need(s.max_results is None or s.max_results > 0, "max_results must be positive")
    need(s.database == "pubmed", "database must be pubmed")
    skipped = []
    for name in ("abstract", "fulltext"):
        stage = getattr(config.screening, name)
        skip = bool(stage.get("skip_stage", False))
        skipped.append(skip)
        if skip and stage.get("objective"):
            warnings.warn(f"{name} screening is skipped; its objective is ignored", stacklevel=2)
        need(skip or bool(stage.get("objective")), f"{name} screening needs an objective or skip_stage: true")
        need(skip or bool(stage.get("inclusion_criteria")), f"{name} screening needs inclusion criteria")
        reporting, threshold = stage.get("confidence_reporting", False), stage.get("threshold")
        need(isinstance(reporting, bool), f"{name} confidence_reporting must be a boolean")
        need(not reporting or threshold is None or 0.0 <= threshold <= 1.0, f"{name} threshold must lie between 0 and 1")
    if all(skipped):
        warnings.warn("both screening stages are skipped: every study passes", stacklevel=2)
    need(bool(config.output.directory.strip()), "output directory is empty")
    for source in config.retrieval.full_text_sources:
        need(not (source.get("coordinates_path_templates") and source.get("processed_data_path")), "coordinates_path_templates and processed_data_path exclude each other")
        need(source.get("pmid_source", "file_name") not in ("json", "folder_name") or bool(source.get("text_path_templates")), "json and folder_name sources need text_path_templates")


def load(path: str | Path) -> PipelineConfig:
    import yaml

    p = Path(path)
    if not p.exists():
        raise ConfigurationError(f"no such file: {p}")
    try:
        given = yaml.safe_load(p.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ConfigurationError(f"not YAML: {e}") from e
    if not given:
        raise ConfigurationError("the configuration is empty")
    return from_dict(given)


def save(config: PipelineConfig, path: str | Path) -> None:
    import yaml

    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(yaml.safe_dump(config.to_dict(), sort_keys=False), encoding="utf-8")


SAMPLE = """\
# A review in five stages: search, screening of abstracts and full texts,
# retrieval, coordinate parsing, annotation.
search:
  database: pubmed
  query: "working memory AND fMRI"    # or pmids_list, or pmids_file
  max_results: 200
  email: you@example.org
retrieval:
  load_excluded: false
  # full_text_sources:
  #   - root_path: /texts
  #     pmid_source: file_name          # or folder_name, json
  #     allowed_extensions: [".txt"]
screening:
  abstract:
    model: gpt-4o-mini
    objective: Find fMRI studies of working memory
    inclusion_criteria: [Human participants, Task fMRI]
    exclusion_criteria: [Reviews, Animal studies]
  fulltext:
    model: gpt-4o-mini
    objective: Find fMRI studies of working memory
    inclusion_criteria: [Reports coordinates]
    exclusion_criteria: [Region-of-interest analyses only]
parsing:
  parse_coordinates: true
output:
  directory: results
  nimads: true
annotation:
  enabled: true
  prompt_type: multi_analysis           # or single_analysis
"""

"""Evidence synthesis and coordinate meta-analysis on PySpark."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

#: Names that are loaded from their modules when they are first used.
_EXPORTS = {
    "get_session": "session", "PipelineConfig": "config", "ConfigurationError": "config", "load": "config", "save": "config", "from_dict": "config",
    "Review": "pipeline", "run_meta": "pipeline", "SearchEngine": "engines", "PubMedSearch": "engines", "ScreeningEngine": "engines", "ModelScreening": "engines",
    "Retriever": "engines", "LocalRetriever": "engines", "CsvFolderRetriever": "engines",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"studyloom.{_EXPORTS[name]}"), name)

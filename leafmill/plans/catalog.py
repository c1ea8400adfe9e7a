"""All queries of the library by name, with their DuckDB twins."""

from __future__ import annotations

import importlib

from leafmill.plans.registry import ORACLES, QUERIES

FLAGSHIP = "join02_apply_translations"
MODULES = ["scans", "naming", "filters", "texts", "boxes", "records", "rollups", "safety", "layout", "jobs", "containers", "streams"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"leafmill.plans.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)

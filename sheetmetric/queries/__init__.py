"""Registry: every query with its reference SQL."""
from __future__ import annotations

import importlib

AREAS = ["measure", "calibrate", "classify", "text", "catalog", "divisions", "spatial", "process", "rules", "graph", "spaces",
         "profile", "pages", "revise", "inspect", "contracts", "sources"]


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for area in AREAS:
        module = importlib.import_module(f"sheetmetric.queries.{area}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles

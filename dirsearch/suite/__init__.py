"""Named queries over the test tables (the driver's correctness surface)."""

from __future__ import annotations

import importlib

MODULES = ["vectors", "criteria", "pages", "retrieval", "querylog", "ingest"]


def load_all():
    for m in MODULES:
        importlib.import_module(f"dirsearch.suite.{m}")
    from dirsearch.suite.registry import ORACLE, QUERIES

    return QUERIES, ORACLE

"""Operators of a training-data pipeline: thirteen corpus operators and their registered queries."""

from __future__ import annotations

import importlib

MODULES = ("alignment", "bpe", "collocations", "html_main", "line_dedup", "lm", "mixing", "near_dup", "quality_model", "quality_rules", "substring",
           "token_files", "topk")


def load_all():
    """(queries, oracle SQL) of the subpackage."""
    for m in MODULES:
        importlib.import_module(f"dirsearch.llm.{m}")
    from dirsearch.llm.registry import ORACLE, QUERIES

    return QUERIES, ORACLE

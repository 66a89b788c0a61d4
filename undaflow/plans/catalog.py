"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

#: Modules of ``undaflow.plans`` that hold QUERIES and ORACLE.
MODULES = ("signal_queries", "window_queries", "spectral_queries", "score_queries", "graph_queries", "stream_queries")


def _gather(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"undaflow.plans.{m}"), attr))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")

"""All registered queries and their DuckDB oracle SQL, merged from the ``q_*`` modules."""

from __future__ import annotations

import importlib

MODULES = ("q_posts", "q_geo", "q_text", "q_sim", "q_topics", "q_ingest", "q_sources")


def _load():
    queries, oracle = {}, {}
    for name in MODULES:
        mod = importlib.import_module(f"crisismap.plans.{name}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries() -> dict:
    return _load()[0]


def oracle_sql() -> dict:
    return _load()[1]

"""All queries of the document engine by name, and the SQL that checks them."""

from __future__ import annotations

import importlib

_MODULES = ("queries_layout", "queries_text", "queries_jobs", "queries_pages", "queries_lane", "queries_reads", "queries_geometry")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f"docweave.{name}")
        queries |= module.QUERIES
        sql |= module.ORACLE_SQL
    return queries, sql

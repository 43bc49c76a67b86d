"""Registered queries: each pairs a call into the library with the SQL that checks it."""

from __future__ import annotations

import importlib

from starslice.workload import registry

_SECTIONS = ("slices", "metrics", "windows", "stats", "report_queries", "quality_queries", "extract_queries", "geo_queries", "fact_queries", "unbounded", "page_queries", "report_table_queries", "file_queries")


def _load() -> None:
    for section in _SECTIONS:
        importlib.import_module(f"starslice.workload.{section}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)

"""Queries over the driver's tables, one or more for each operator, with their equivalents in SQL.

How tables stand for entities: documents are file entries (path, content, order), the number in source is the layer; lineitem
is manifest, place, blob and repository; orders are tags; events are cache traffic; pages are hosts and paths; region is the registry.
"""

from __future__ import annotations

from . import assembly, assertions, caching, deploy, functions, graphs, layers, lookups, sources
from .registry import QUERIES, SQL

__all__ = ["assembly", "assertions", "caching", "deploy", "functions", "graphs", "layers", "lookups", "sources"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)

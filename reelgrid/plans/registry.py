"""All queries of the core, by name."""

from __future__ import annotations

from reelgrid.plans import entry_queries, etl_queries, evaluation_queries, interval_queries, search_queries, source_queries

_MODULES = [search_queries, etl_queries, evaluation_queries, interval_queries, source_queries, entry_queries]

QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}

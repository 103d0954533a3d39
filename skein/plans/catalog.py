"""Every query that the engine registers, with its SQL."""

from __future__ import annotations

from skein.plans import graph_queries, page_queries, retrieval_queries, session_queries, trace_queries
from skein.plans.registry import Query

_CATALOGS = (retrieval_queries.catalog, graph_queries.catalog, trace_queries.catalog, session_queries.catalog, page_queries.catalog)
QUERIES: dict[str, Query] = {name: query for c in _CATALOGS for name, query in c.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for c in _CATALOGS for name, sql in c.sql.items()}

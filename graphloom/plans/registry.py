"""All queries of the core, and their SQL."""

from __future__ import annotations

from graphloom.plans import corpus_queries, extraction_queries, graph_queries, problems

_MODULES = (problems, graph_queries, corpus_queries, extraction_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}

"""All queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from graphloom.llm import queries_code, queries_corpus, queries_text

_MODULES = (queries_text, queries_code, queries_corpus)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}

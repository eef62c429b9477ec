"""All registered queries of the engine proper, with their DuckDB equivalents."""

from __future__ import annotations

from galleyproof.plans import commit_queries, go_queries, graph_queries, hook_queries, knowledge_queries, render_queries, text_queries, turn_queries

_PARTS = (text_queries, commit_queries, graph_queries, hook_queries, knowledge_queries, go_queries, turn_queries, render_queries)
QUERIES: dict = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}

"""All registered queries with their oracle SQL."""

from . import derived_queries, graph_queries, project_queries, resolve_queries, search_queries, stored_queries, text_queries

_MODULES = [graph_queries, search_queries, resolve_queries, derived_queries, text_queries, project_queries, stored_queries]


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

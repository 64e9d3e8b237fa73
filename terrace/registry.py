"""The queries of the engine's own operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from terrace.plans import measure_queries, task_queries

FLAGSHIP = "t1_analysis"
MODULES = (task_queries, measure_queries)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

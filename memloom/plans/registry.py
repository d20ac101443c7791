"""All queries of the core and their SQL."""

from __future__ import annotations

from memloom.plans import core_problems, scalar_queries, search_queries, store_queries, upkeep_queries

MODULES = [core_problems, scalar_queries, search_queries, store_queries, upkeep_queries]
FLAGSHIP = "retrieve_hybrid"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

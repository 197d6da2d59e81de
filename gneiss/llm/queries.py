"""The catalogue of this package's queries and their oracle SQL."""

from __future__ import annotations

from gneiss.llm import queries_tabular, queries_text, queries_vectors

MODULES = [queries_tabular, queries_text, queries_vectors]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

"""The core's query catalogue: every query by name, with its oracle SQL where SQL can say it."""

from __future__ import annotations

from gneiss import queries_geometry, queries_models, queries_predict, queries_prepare, queries_raw, queries_sweep

MODULES = [queries_raw, queries_prepare, queries_geometry, queries_predict, queries_models, queries_sweep]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

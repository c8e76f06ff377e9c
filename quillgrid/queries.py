"""All queries of the worksheet library, gathered from the modules in ``plans``."""

from __future__ import annotations

from .plans import aggregates, business, display, extras, grid, scalars, series, statistics, tables

_MODULES = (aggregates, scalars, tables, series, statistics, business, display, extras, grid)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}

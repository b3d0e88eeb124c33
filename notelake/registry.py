"""Every query of the library, by name, with the SQL it is held against."""

from __future__ import annotations

from notelake.queries import flows, graph, recall, texts

_MODULES = (texts, recall, graph, flows)


def queries():
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}

"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import rollups, streams, tables, telemetry, upkeep

_MODULES = (telemetry, rollups, tables, upkeep, streams)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

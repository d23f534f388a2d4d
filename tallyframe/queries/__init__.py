"""Operators bound to the warehouse tables, each with its oracle SQL."""

from __future__ import annotations

from tallyframe.queries import audit, figures, statistics, typography

MODULES = (statistics, typography, figures, audit)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}

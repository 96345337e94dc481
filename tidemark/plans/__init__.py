"""Registered queries: every operator applied to the shared tables, beside its SQL equivalent."""

from __future__ import annotations


def _modules() -> list:
    from . import broken, churn, domains, experiments, features, funnels, models, quality, recommend, reporting, retention

    return [funnels, retention, quality, churn, features, recommend, experiments, models, reporting, domains, broken]


def queries() -> dict:
    return {name: query for m in _modules() for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql}

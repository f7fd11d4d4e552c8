"""Registered queries: name -> (callable(spark, folder), DuckDB SQL or None)."""

from __future__ import annotations

from tidemark.plans.queries.common import REGISTRY
from tidemark.plans.queries import ingestion, cleaning, algebra, shape, identify, models, assess, layouts  # noqa: F401


def queries():
    return {name: q for name, (q, _) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}

"""Query registry: every registered query pairs a DataFrame plan with an independent SQL oracle text.

Queries are grouped by topic in the ``q_*`` modules of this package; each module registers itself on import.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registered:
    name: str
    fn: QueryFn
    sql: str | None
    survey_ids: tuple[str, ...]


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL (None → rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = Registered(name, fn, sql, ids)
        return fn

    return deco


def load_all() -> dict[str, Registered]:
    from panelkit.plans import (  # noqa: F401  (imports register the queries)
        q_conform,
        q_drift,
        q_features,
        q_functions,
        q_io,
        q_ml,
        q_monitor,
        q_pairs,
        q_quality,
        q_report,
        q_stream,
        q_topk,
    )

    return REGISTRY

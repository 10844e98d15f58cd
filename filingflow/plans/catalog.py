"""Query catalogue: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> DuckDB SQL``.

Each name is one SURVEY §2 inventory id. The Spark side states the rewritten, partition-friendly
plan; the oracle states the reference's own form (views with COUNT DISTINCT, scalar subqueries,
LIMIT before filter, ...) over the same bindings, so equality proves the rewrite.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filingflow.plans.fixture_sql import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, tables: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_tables(oracle, *tables)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from filingflow.plans import (  # noqa: F401
        q_documents,
        q_jobs,
        q_listing,
        q_registry,
        q_report,
        q_search,
        q_stats,
        q_streams,
    )

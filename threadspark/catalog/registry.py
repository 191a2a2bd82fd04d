"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadspark.catalog.inputs import Inputs, oracle

Query = Callable[[Inputs], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` may use the input views by name."""
    def add(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} registered twice")
        _queries[name] = fn
        if sql is not None:
            _oracles[name] = oracle(sql)
        return fn

    return add


def _load() -> None:
    from threadspark.catalog import q_comments, q_posts, q_rules, q_runs, q_sources, q_state, q_streams  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, fn=fn: fn(Inputs(spark, sf_dir))) for name, fn in _queries.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)

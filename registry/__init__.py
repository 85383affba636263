"""Registered queries: each operator on the given tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query and, where SQL can state it, its DuckDB counterpart."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    from registry import cleaning, modelling, overtime, pages, volumes  # noqa: F401

"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

LLM_QUERIES: dict[str, Callable] = {}
LLM_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query function ``(spark, folder) -> DataFrame``."""
    def keep(function):
        LLM_QUERIES[name] = function
        if sql is not None:
            LLM_ORACLES[name] = sql
        return function
    return keep

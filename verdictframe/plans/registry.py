"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictframe.sources.views import TABLES, VIEWS, duck_view, view_closure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every derived view it mentions."""
    body = sql.strip()
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = [f"{v} AS ({duck_view(v)})" for v in view_closure(names)]
    head = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if head:
        body = body[head.end():]
        joined = ", ".join(ctes + [body])
        return f"WITH RECURSIVE {joined}"
    if not ctes:
        return body
    return f"WITH RECURSIVE {', '.join(ctes)} {body}"


def query(name: str, oracle: str | None = None):
    """Register a query callable, with its oracle when SQL can express it."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return wrap


__all__ = ["QUERIES", "ORACLES", "query", "with_views", "TABLES"]

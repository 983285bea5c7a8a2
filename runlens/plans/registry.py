"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens.plans.fixtures import VIEW_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query. ``sql`` may use the fixture views; their definitions are put in front."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    used: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        found = {v for v in VIEW_SQL if re.search(rf"\b{v}\b", text)} - used
        used |= found
        texts += [VIEW_SQL[v] for v in found]
    views = ", ".join(f"{v} as ({VIEW_SQL[v].strip()})" for v in VIEW_SQL if v in used)
    sql = sql.strip()
    if not views:
        return sql
    if sql.lower().startswith("with recursive"):
        return f"with recursive {views}, {sql[14:]}"
    if sql.lower().startswith("with "):
        return f"with {views}, {sql[5:]}"
    return f"with {views} {sql}"

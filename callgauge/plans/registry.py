"""Registered queries: each Spark query beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callgauge.plans.views import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Put the definitions of the views a statement mentions in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name in text and name not in needed:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    order = [n for n in VIEW_SQL if n in needed]
    if not order:
        return sql
    head = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {head},\n{body[4:].lstrip()}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; without ``sql`` only its rows are checked."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap

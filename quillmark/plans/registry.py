"""Named queries over the given tables, each with an optional DuckDB twin.

A query is a function ``(Views) -> DataFrame``. Its twin is SQL text; the views
it names are prepended as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.plans.views import ORACLE_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prepend every view the text names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_]+\b", text)):
            if word in ORACLE_VIEWS and word not in needed:
                visit(ORACLE_VIEWS[word].replace(f" {word} ", " "))
                if word not in needed:
                    needed.append(word)

    visit(body)
    ctes = [f"{name} AS MATERIALIZED ({ORACLE_VIEWS[name]})" for name in needed]
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, oracle: str | None = None):
    def keep(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views.of(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return keep

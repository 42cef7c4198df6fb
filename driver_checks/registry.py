"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_checks.fixtures import CTES, NEEDS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
#: SQL text and the named expressions it uses; composed when asked for, so that modules may name expressions of later ones.
TWINS: dict[str, tuple[str, tuple[str, ...]]] = {}


def extend(ctes: dict[str, str], needs: dict[str, list[str]] | None = None) -> None:
    """Add named expressions other checks can build on; later names may use earlier ones."""
    CTES.update(ctes)
    NEEDS.update(needs or {})


def compose(body: str, *names: str) -> str:
    """``body`` with the named expressions, and what they need, in front; an unknown name is an error."""
    wanted: dict[str, None] = {}  # in order of dependence

    def need(name: str) -> None:
        if name not in CTES:
            raise KeyError(f"no expression {name!r}")
        if name not in wanted:
            for other in NEEDS.get(name, []):
                need(other)
            wanted[name] = None

    for name in names:
        need(name)
    if not wanted:
        return body

    def head(name: str) -> str:
        # "name(columns) using key (...)" is written as a tuple-like prefix before a colon.
        text = CTES[name]
        if text.startswith("@"):
            header, text = text[1:].split("@", 1)
            return f"{header} as ({text})"
        return f"{name} as materialized ({text})"

    return "with recursive " + ",\n".join(map(head, wanted)) + "\n" + body


def flat(df: DataFrame) -> DataFrame:
    """Comparable columns: whole numbers as bigint, doubles to six digits, arrays as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("tinyint", "smallint", "int") or kind.startswith("decimal"):
            c = c.cast("bigint")
        elif kind in ("double", "float"):
            # Adding zero turns -0.0 into 0.0.
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind.startswith("array<"):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(name))
    return df.select(*out)


def check(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = lambda spark, folder: flat(query(spark, folder))
        if sql is not None:
            TWINS[name] = (sql, ctes)
        return query

    return register

"""The list of queries and the shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        key = name or run.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Entry(run, sql)
        return run

    return add


def fragment(name: str, sql: str, *needs: str) -> None:
    """Declare a named subquery that others can build on."""
    FRAGMENTS[name] = (needs, sql.strip())


def with_(body: str, *needs: str, recursive: bool = False) -> str:
    """``body`` preceded by the named subqueries and all they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in FRAGMENTS[name][0]:
            visit(need)
        ordered.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{n} AS (\n{FRAGMENTS[n][1]}\n)" for n in ordered)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{parts}\n{body.strip()}" if parts else body.strip()


def rounded_sql(body: str, exact: str, doubles: str, *needs: str, digits: int = 6, recursive: bool = False) -> str:
    """``body`` with its double columns rounded, so that the order of a sum does not show."""
    cells = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
    kept = ", ".join(exact.split())
    listed = ", ".join(x for x in (kept, cells) if x)
    return with_(f"SELECT {listed} FROM (\n{body.strip()}\n)", *needs, recursive=recursive)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

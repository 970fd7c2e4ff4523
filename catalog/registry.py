"""Registration of queries and the shared SQL of the derived tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.decimals import DECIMALS
from routelore.sources.staging import stage_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


# A view is a lazy definition: remembering it saves repeated schema reads and plan building, never data.
lazy_view = lru_cache(maxsize=None)


def staged_view(fn):
    """A lazy view whose result is written once per session and folder, as each job's output table is."""

    @lru_cache(maxsize=None)
    def staged(spark: SparkSession, d: str) -> DataFrame:
        return stage_table(fn(spark, d), fn.__name__)

    staged.lazy = fn
    return staged


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def with_tables(body: str, *names: str, recursive: bool = False) -> str:
    """The SQL text preceded by the derived tables it names, and by what those need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        body = ",\n" + body[5:] if head else " " + body[5:]
    else:
        body = "\n" + body
    word = "WITH RECURSIVE " if recursive else "WITH "
    return f"{word}{head}{body}" if head or body.startswith(" ") else body.strip()


def nudge(decimals: int) -> float:
    """Far below the last digit kept: moves exact halves, which engines round differently, off the boundary."""
    return 1.23 * 10.0 ** -(decimals + 3)


def query(name: str, sql: str | None = None, *tables: str, recursive: bool = False):
    """Registers a (spark, folder) -> DataFrame function, with SQL over the named derived tables."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        columns = {c: k for k, text in DECIMALS.get(name, {}).items() for c in text.split()} if sql is not None else {}

        def rounded(spark: SparkSession, d: str) -> DataFrame:
            # Adding 0.0 turns a negative zero into zero.
            return fn(spark, d).withColumns({c: F.round(F.col(c) + F.lit(nudge(k)), k) + F.lit(0.0) for c, k in columns.items()})

        QUERIES[name] = rounded if columns else fn
        if sql is not None:
            text = with_tables(sql, *tables, recursive=recursive)
            if columns:
                parts = ", ".join(f'round("{c}" + {nudge(k)}::DOUBLE, {k}) + 0.0::DOUBLE AS "{c}"' for c, k in columns.items())
                text = f"SELECT * REPLACE ({parts}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return register

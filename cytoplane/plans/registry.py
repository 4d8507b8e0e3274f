"""Registry of runnable queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Named SQL building blocks: name -> (blocks it needs, text).
BLOCKS: dict[str, tuple[str, str]] = {}


def block(name: str, needs: str, text: str) -> None:
    BLOCKS[name] = (needs, text)


def with_blocks(needs: str, body: str) -> str:
    """``body`` behind a WITH clause holding the blocks it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in BLOCKS[name][0].split():
                visit(other)
            order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body
    recursive = "RECURSIVE " if any("UNION ALL" in BLOCKS[n][1] for n in order) else ""
    heads = ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in order)
    return f"WITH {recursive}{heads}\n{body}"


def query(name: str, needs: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(func: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = func
        if sql is not None:
            ORACLES[name] = with_blocks(needs, sql)
        return func

    return add

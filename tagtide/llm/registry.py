"""Queries of this subpackage, with SQL where SQL can state them."""

from __future__ import annotations

from tagtide.catalogue.registry import Query, Run

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return add

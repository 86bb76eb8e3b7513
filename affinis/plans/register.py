"""The registered queries: name -> function, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
_PLANNED: ContextVar[dict | None] = ContextVar("planned", default=None)


def registered(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query (spark, sf_dir) -> DataFrame under its function's name, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        @wraps(f)
        def query(spark, sf_dir):
            token = _PLANNED.set({})
            try:
                return f(spark, sf_dir)
            finally:
                _PLANNED.reset(token)

        QUERIES[f.__name__] = query
        if sql:
            ORACLE[f.__name__] = sql
        return query

    return add


def shared(f: Callable) -> Callable:
    """A table (spark, sf_dir) that several parts of one query read: made once in that query, and not kept beyond it."""

    @wraps(f)
    def table(spark, sf_dir, *more):
        planned = _PLANNED.get()
        if planned is None:
            return f(spark, sf_dir, *more)
        key = (f.__module__, f.__name__, sf_dir, more)
        if key not in planned:
            planned[key] = f(spark, sf_dir, *more)
        return planned[key]

    return table

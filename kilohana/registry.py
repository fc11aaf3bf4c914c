"""Names of all queries of the core, with their DuckDB twins. The modules of ``kilohana.plans`` fill it on import."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ["text", "scan", "filter", "search", "result", "join", "aggregate", "maintain", "graph", "html", "stream"]
_loaded = False


def op(name: str, sql: str | None = None) -> Callable:
    """Register a query under a name of the operator inventory, with its DuckDB SQL where SQL can say the same."""

    def wrap(fn: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def both(name: str, sql: str, *tables: str, duck: str | None = None, **other: str) -> None:
    """Register a query whose statement reads alike in Spark SQL and DuckDB; ``duck`` where the dialects part. Tables stand in braces for Spark."""
    from kilohana.session import table

    def fn(spark, sf):
        return spark.sql(sql, **{t: table(spark, sf, t) for t in tables})

    fn.__name__ = name
    fn.__doc__ = other.get("doc")
    plain = sql
    for t in tables:
        plain = plain.replace("{" + t + "}", t)
    op(name, duck or plain)(fn)


def _load() -> None:
    global _loaded
    if not _loaded:
        for m in _MODULES:
            importlib.import_module(f"kilohana.plans.{m}")
        _loaded = True


def entry(spark, sf_dir):
    _load()
    return _QUERIES["rt03"](spark, sf_dir)


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

"""Predicates and semi-joins that restrict what a query sees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_blocked(group: Column, blocked: list[str]) -> Column:
    """NOT IN: a null group is dropped, as SQL does."""
    return ~group.isin(blocked)


def drop_groups(rows: DataFrame, sources: DataFrame, blocked: list[str]) -> DataFrame:
    """Anti-join with the sources of blocked groups."""
    return rows.join(sources.where(F.col("groupname").isin(blocked)).select("sourceid").distinct(), "sourceid", "left_anti")


def keep_groups(rows: DataFrame, sources: DataFrame, blocked: list[str]) -> DataFrame:
    """Semi-join with the sources of the other groups."""
    return rows.join(sources.where(not_blocked(F.col("groupname"), blocked)).select("sourceid").distinct(), "sourceid", "left_semi")


def contains_any(df: DataFrame, cols: list[str], term: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False)) for c in cols]))


def good_content(c: Column) -> Column:
    return (F.octet_length(c) >= 20) & ~(c.rlike("^[^a-z]*$") & c.rlike("[A-Z]")) & ~c.rlike(r"^(?:Page|ʻAoao|Chapter)\s") & ~c.rlike(r"^[\d\s.,]+$")


def log_page(log: DataFrame, operation: str | None = None, group: str | None = None, status: str | None = None, start: str | None = None, end: str | None = None, size: int = 100) -> DataFrame:
    """Processing-log rows by filters; bounds are Honolulu dates. Ascending where ``start`` is given, else descending."""
    tz = lambda d: F.convert_timezone(F.lit("Pacific/Honolulu"), F.lit("UTC"), F.lit(d).cast("timestamp_ntz"))
    for col, v in (("operation_type", operation), ("groupname", group), ("status", status)):
        if v is not None:
            log = log.where(F.col(col) == v)
    if start:
        log = log.where(F.col("started_at") >= tz(start))
    if end:
        log = log.where(F.col("started_at") < tz(end))
    return log.orderBy(*(["started_at", "log_id"] if start else [F.desc("started_at"), F.desc("log_id")])).limit(size)

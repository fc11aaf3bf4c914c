"""Mutations as plans: upserts, anti-joined appends, deletions, id allocation, differences. Each returns the new state; writing it is one overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose key new does not hold. Repeats of a key within new must be settled before (latest)."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key old does not hold, each key once."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def delete_where_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def keep_where_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def update_columns(df: DataFrame, staging: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Staged values where there are any."""
    st = staging.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    j = df.join(st, key, "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def allocate_ids(old: DataFrame, new: DataFrame, key: str, natural: str) -> DataFrame:
    """New rows get ids after the largest, in order of their natural key; a natural key that is known or comes twice gets none.

    Numbers are dealt by range: rows are sorted in parallel, each range's count is gathered (one number a partition), and a row's id is its range's offset plus
    its place, so no single task sees all rows.
    """
    fresh = new.dropDuplicates([natural]).join(old.select(natural).distinct(), natural, "left_anti")
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    ranged = fresh.repartitionByRange(F.col(natural)).sortWithinPartitions(natural).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
    size = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    out = ranged.join(before, "_p").crossJoin(F.broadcast(top))
    return out.select((F.col("_top") + F.col("_before") + F.col("_i") + 1).alias(key), *[c for c in new.columns if c != key])


def sync_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.subtract(right).select(F.lit("missing").alias("side"), key).unionByName(right.subtract(left).select(F.lit("extra").alias("side"), key))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rendered(rows: DataFrame, key: str, name: str, link: str) -> DataFrame:
    """(key, kind, line): each row as JSON, as a list item, and as lines for a terminal; one pass over the rows."""
    n, u = F.col(name), F.col(link)
    lines = {
        "json": F.to_json(F.struct(key, name, link)),
        "html": F.concat(F.lit('<li><a href="'), html_escaped(u), F.lit('">'), html_escaped(n), F.lit("</a></li>")),
        "cli": F.concat(F.lpad(F.col(key).cast("string"), 8, " "), F.lit("  "), n, F.lit("\n          "), u),
    }
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("line")) for k, v in lines.items()])).alias("r")).select(key, "r.kind", "r.line")

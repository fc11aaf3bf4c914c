"""Vector retrieval: exact cosine against a query vector, top k, and fused rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kilohana.functions.text import cosine


def query_vector(vectors: DataFrame, vec_id: int = 0) -> DataFrame:
    """One row (q): the stored vector that stands for the query. One row is all that is ever broadcast."""
    return vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q")).limit(1)


def scored(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """vectors with cos against the single query row."""
    return vectors.crossJoin(F.broadcast(query)).withColumn("cos", cosine(F.col("embedding"), F.col("q"))).drop("q")


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows of the highest score; ties to the smaller key. A take-ordered, not a sort."""
    return df.orderBy(F.desc(score), key).limit(k)


def knn(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(vec_id, score) by (1+cos)/2."""
    s = scored(vectors, query).select("vec_id", F.round((1 + F.col("cos")) / 2, 6).alias("score"))
    return top_k(s, "score", "vec_id", k)


def min_max(df: DataFrame, score: str, out: str) -> DataFrame:
    """score scaled to 0..1 over all rows of a bounded hit list; 0 where all are equal."""
    b = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return df.crossJoin(F.broadcast(b)).withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def rrf(lists: list[DataFrame], key: str, score: str = "score", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of bounded hit lists: sum of 1/(k+rank)."""
    out = None
    for x in lists:
        r = x.select(key, (1.0 / (F.lit(k) + F.row_number().over(W.orderBy(F.desc(score), key)))).alias("_r"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy(key).agg(F.round(F.sum("_r"), 8).alias("score"))

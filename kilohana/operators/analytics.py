"""Corpus analytics: grids, shares, histograms, log statistics. Windows run over aggregates only, never over the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FIXED = [(1, 5), (6, 10), (11, 15), (16, 20), (21, 30), (31, 50)]
SEVEN = [(1, 10), (11, 25), (26, 50), (51, 100), (101, 250), (251, 500)]
LATENCY = [50, 100, 250, 500, 1000, 2000]


def decade_grid(rows: DataFrame) -> DataFrame:
    """(decade, pattern_type, n, mean) from (pattern_type, date)."""
    c = rows.where("date IS NOT NULL").groupBy("pattern_type", (F.floor(F.year("date") / 10) * 10).alias("decade")).agg(F.count("*").alias("n"))
    grid = c.select("pattern_type").distinct().crossJoin(F.broadcast(c.select("decade").distinct()))  # rule names by decades: both are bounded
    g = grid.join(c, ["pattern_type", "decade"], "left").select("decade", "pattern_type", F.coalesce("n", F.lit(0)).alias("n"))
    return g.withColumn("mean", F.round(F.avg("n").over(W.partitionBy("decade")), 4))


def share_of_total(df: DataFrame, col: str, out: str, digits: int) -> DataFrame:
    t = df.agg(F.sum(col).alias("_t"))
    return df.crossJoin(F.broadcast(t)).withColumn(out, F.round(100.0 * F.col(col) / F.col("_t"), digits)).drop("_t")


def fixed_bucket(c: Column) -> Column:
    e = F.lit("more")
    for a, b in reversed(FIXED):
        e = F.when(c.between(a, b), F.lit(f"{a}-{b}")).otherwise(e)
    return e


def seven_buckets(hist: DataFrame) -> DataFrame:
    e = F.lit(">500")
    for a, b in reversed(SEVEN):
        e = F.when(F.col("wordcount").between(a, b), F.lit(f"{a}-{b}")).otherwise(e)
    return hist.where("wordcount > 0").groupBy(e.alias("bucket")).agg(F.sum("c").alias("c"))


def equal_frequency(hist: DataFrame, n: int) -> DataFrame:
    total = hist.agg(F.sum("c").alias("total"))
    r = hist.withColumn("run", F.sum("c").over(W.orderBy("wordcount"))).crossJoin(F.broadcast(total))
    b = F.least(F.floor((F.col("run") - F.col("c")) * n / F.col("total")), F.lit(n - 1))
    return r.groupBy(b.alias("bucket")).agg(F.min("wordcount").alias("lo"), F.max("wordcount").alias("hi"), F.sum("c").alias("c"))


def geometric_edges(linear: int, step: int, top: int, factor: float = 1.5) -> list[tuple[int, int]]:
    """Buckets of ``step`` up to ``linear``, then each ``factor`` times as wide."""
    out, lo, width = [], 1, float(step)
    while lo <= top:
        if lo > linear:
            width *= factor
        hi = lo + int(width) - 1
        out.append((lo, hi))
        lo = hi + 1
    return out


def by_pattern(stats: DataFrame) -> DataFrame:
    return stats.groupBy(F.lower("pattern").alias("pattern")).agg(F.count("*").alias("n"), F.round(F.avg("elapsed"), 4).alias("avg_elapsed")).orderBy(F.desc("n"), "avg_elapsed")


def latency_bins(stats: DataFrame) -> DataFrame:
    e = F.lit(1_000_000)
    for b in reversed(LATENCY):
        e = F.when(F.col("elapsed") <= b, F.lit(b)).otherwise(e)
    got = stats.where("elapsed IS NOT NULL").groupBy(e.alias("bin")).agg(F.count("*").alias("n"))
    grid = stats.sparkSession.createDataFrame([(b,) for b in [*LATENCY, 1_000_000]], "bin int")
    return grid.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def by_local_day(stats: DataFrame, tz: str = "Pacific/Honolulu") -> DataFrame:
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("created")))
    return stats.where("created IS NOT NULL").groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def timings(log: DataFrame) -> DataFrame:
    sec = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("completed_at")) / 1e6
    return log.where("completed_at IS NOT NULL AND started_at IS NOT NULL").groupBy("operation_type").agg(F.count("*").alias("n"), F.round(F.sum(sec), 3).alias("total"), F.round(F.avg(sec), 3).alias("mean"))

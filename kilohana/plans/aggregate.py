"""Aggregations (AG)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kilohana.functions import text as T
from kilohana.operators import analytics as A
from kilohana.operators import search as S
from kilohana.plans.join import PATTERNS, patterns
from kilohana.plans.result import _HIST, _hist
from kilohana.plans.search import SENTS, sents, toks
from kilohana.plans.text import ENTITY
from kilohana.registry import both, op
from kilohana.session import table

H = "hawaiiantext"


@op("ag01", f"SELECT 'match' AS mode, count(*) AS n FROM {SENTS} WHERE list_contains({toks()},'mahina') UNION ALL SELECT 'vector', -1 UNION ALL SELECT 'all rows', count(*) FROM {SENTS}")
def ag01(spark, sf):
    """Matches by mode; -1 where a mode ranks everything; all rows for an empty query."""
    s = sents(spark, sf)
    out = S.count(s, "match", "mahina").select(F.lit("match").alias("mode"), "n")
    out = out.unionByName(S.count(s, "vector", "mahina").select(F.lit("vector").alias("mode"), "n"))
    return out.unionByName(S.count(s, "match", "").select(F.lit("all rows").alias("mode"), "n"))


both("ag02", "SELECT sourceid, count(hawaiiantext) AS n FROM {sentences} GROUP BY sourceid", "sentences")
both("ag03", "SELECT o.sourceid, max(o.sourcename) AS sourcename, count(s.sentenceid) AS n FROM {sources} o JOIN {sentences} s ON s.sourceid = o.sourceid GROUP BY o.sourceid HAVING count(s.sentenceid) > 0 ORDER BY sourcename, o.sourceid", "sources", "sentences")
both("ag04", "SELECT count(DISTINCT sourceid) AS n FROM {sources}", "sources")
both("ag05", "SELECT o.groupname, count(DISTINCT o.sourceid) AS n FROM {sources} o JOIN {sentences} s ON s.sourceid = o.sourceid GROUP BY o.groupname", "sources", "sentences")
both("ag06", "SELECT groupname, count(DISTINCT sourceid) AS n FROM {sources} GROUP BY groupname", "sources")
both("ag07", "SELECT wordcount, count(*) AS c FROM {sentences} GROUP BY wordcount", "sentences")
both("ag08", "SELECT wordcount, count(*) AS c FROM {contents} GROUP BY wordcount", "contents")
both("ag09", "SELECT groupname, max(date) AS latest FROM {sources} GROUP BY groupname", "sources")
both("ag10", "SELECT (SELECT count(*) FROM {sentences}) AS sentences, (SELECT count(*) FROM {contents}) AS documents", "sentences", "contents")
both("ag11", "SELECT 'sources' AS name, count(*) AS n FROM {sources} UNION ALL SELECT 'contents', count(*) FROM {contents} UNION ALL SELECT 'sentences', count(*) FROM {sentences} UNION ALL SELECT 'searchstats', count(*) FROM {searchstats} UNION ALL SELECT 'processing_log', count(*) FROM {processing_log} UNION ALL SELECT 'documents', count(*) FROM {documents}", "sources", "contents", "sentences", "searchstats", "processing_log", "documents")


@op("ag12", f"SELECT pattern_type, count(*) AS n FROM {PATTERNS} p GROUP BY 1")
def ag12(spark, sf):
    return patterns(spark, sf).groupBy("pattern_type").agg(F.count("*").alias("n"))


_DATED = f"(SELECT p.pattern_type, x.date FROM {PATTERNS} p JOIN (SELECT sourceid, max(date) AS date FROM sources GROUP BY 1) x ON x.sourceid=p.sourceid)"


def _dated(spark, sf):
    x = table(spark, sf, "sources").groupBy("sourceid").agg(F.max("date").alias("date"))
    return patterns(spark, sf).join(x, "sourceid").select("pattern_type", "date")


@op("ag13", f"SELECT pattern_type, count(*) AS n FROM {_DATED} d WHERE date BETWEEN DATE '1900-01-01' AND DATE '1999-12-31' GROUP BY 1")
def ag13(spark, sf):
    return _dated(spark, sf).where("date BETWEEN DATE '1900-01-01' AND DATE '1999-12-31'").groupBy("pattern_type").agg(F.count("*").alias("n"))


@op("ag14", f"SELECT pattern_type, count(*) AS n FROM {PATTERNS} p GROUP BY 1 ORDER BY n DESC, pattern_type")
def ag14(spark, sf):
    return patterns(spark, sf).groupBy("pattern_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern_type")


@op("ag15", f"WITH c AS (SELECT pattern_type, (year(date)//10)*10 AS decade, count(*) AS n FROM {_DATED} d WHERE date IS NOT NULL GROUP BY 1,2), g AS (SELECT p.pattern_type, q.decade FROM (SELECT DISTINCT pattern_type FROM c) p, (SELECT DISTINCT decade FROM c) q) SELECT g.decade, g.pattern_type, coalesce(c.n,0) AS n, round(avg(coalesce(c.n,0)) OVER (PARTITION BY g.decade),4) AS mean FROM g LEFT JOIN c ON c.pattern_type=g.pattern_type AND c.decade=g.decade")
def ag15(spark, sf):
    """Counts by decade and pattern, zeros filled in, with the decade's mean over patterns."""
    return A.decade_grid(_dated(spark, sf))


@op("ag16", f"SELECT pattern_type, round(100.0*n/sum(n) OVER (),1)::DOUBLE AS pct FROM (SELECT pattern_type, count(*) AS n FROM {PATTERNS} p GROUP BY 1) t")
def ag16(spark, sf):
    return A.share_of_total(ag12(spark, sf), "n", "pct", 1).select("pattern_type", "pct")


@op("ag17", "SELECT year(date) AS y, round(100.0*count(*)/(SELECT count(*) FROM sources),2)::DOUBLE AS pct FROM sources WHERE date IS NOT NULL GROUP BY 1")
def ag17(spark, sf):
    """Share of documents by year; undated ones count in the denominator."""
    s = table(spark, sf, "sources")
    by = s.where("date IS NOT NULL").groupBy(F.year("date").alias("y")).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(s.agg(F.count("*").alias("t")))).select("y", F.round(100.0 * F.col("n") / F.col("t"), 2).alias("pct"))


_BUCKET = "CASE " + " ".join(f"WHEN wordcount BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in A.FIXED) + " ELSE 'more' END"


@op("ag18", f"SELECT {_BUCKET} AS bucket, CAST(sum(c) AS BIGINT) AS c FROM {_HIST} h GROUP BY 1")
def ag18(spark, sf):
    """Fixed buckets; the first that holds a value takes it."""
    return _hist(spark, sf).groupBy(A.fixed_bucket(F.col("wordcount")).alias("bucket")).agg(F.sum("c").alias("c"))


_SEVEN = "CASE " + " ".join(f"WHEN wordcount BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in A.SEVEN) + " WHEN wordcount > 500 THEN '>500' END"


@op("ag19", f"SELECT {_SEVEN} AS bucket, CAST(sum(c) AS BIGINT) AS c FROM {_HIST} h WHERE wordcount>0 GROUP BY 1")
def ag19(spark, sf):
    return A.seven_buckets(_hist(spark, sf))


@op("ag20", f"WITH r AS (SELECT wordcount, c, sum(c) OVER (ORDER BY wordcount) AS run, sum(c) OVER () AS total FROM {_HIST} h WHERE wordcount>0) SELECT CAST(least(floor((run-c)*10/total),9) AS BIGINT) AS bucket, min(wordcount) AS lo, max(wordcount) AS hi, CAST(sum(c) AS BIGINT) AS c FROM r GROUP BY 1")
def ag20(spark, sf):
    """Buckets of equal frequency from the running total."""
    return A.equal_frequency(_hist(spark, sf).where("wordcount > 0"), 10)


_EDGES = A.geometric_edges(50, 10, 2000)


@op("ag21", "WITH e AS (SELECT unnest([" + ",".join(str(a) for a, _ in _EDGES) + "]) AS lo, unnest([" + ",".join(str(b) for _, b in _EDGES) + f"]) AS hi) SELECT e.lo, e.hi, CAST(coalesce(sum(h.c),0) AS BIGINT) AS c FROM e LEFT JOIN {_HIST} h ON h.wordcount BETWEEN e.lo AND e.hi GROUP BY 1,2")
def ag21(spark, sf):
    """Linear buckets, then growing ones."""
    e = spark.createDataFrame(_EDGES, "lo long, hi long")
    h = _hist(spark, sf)
    return F.broadcast(e).join(h, (h["wordcount"] >= e["lo"]) & (h["wordcount"] <= e["hi"]), "left").groupBy("lo", "hi").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"))


both("ag22", "SELECT pattern, count(*) AS n, min(created) AS first_time FROM {searchstats} GROUP BY pattern", "searchstats")


@op("ag23", "SELECT lower(pattern) AS pattern, count(*) AS n, round(avg(elapsed),4) AS avg_elapsed FROM searchstats GROUP BY 1 ORDER BY n DESC, avg_elapsed")
def ag23(spark, sf):
    return A.by_pattern(table(spark, sf, "searchstats"))


_BINS = "CASE " + " ".join(f"WHEN elapsed<={b} THEN {b}" for b in A.LATENCY) + " ELSE 1000000 END"


@op("ag23_latency", f"SELECT b.bin, count(t.bin) AS n FROM (SELECT unnest({[*A.LATENCY, 1000000]}) AS bin) b LEFT JOIN (SELECT {_BINS} AS bin FROM searchstats WHERE elapsed IS NOT NULL) t ON t.bin=b.bin GROUP BY 1")
def ag23_latency(spark, sf):
    """Seven latency bins, empty ones shown."""
    return A.latency_bins(table(spark, sf, "searchstats"))


@op("ag23_days", "SELECT CAST(created - INTERVAL 10 HOUR AS DATE) AS day, count(*) AS n FROM searchstats WHERE created IS NOT NULL GROUP BY 1")
def ag23_days(spark, sf):
    """Queries by Honolulu day."""
    return A.by_local_day(table(spark, sf, "searchstats"))


both("ag24", "SELECT hawaiiantext, count(*) AS frequency FROM {sentences} GROUP BY hawaiiantext", "sentences")


@op("ag25", "WITH d AS (SELECT md5(hawaiiantext) AS hash, sourceid, min(sentenceid) AS i FROM sentences GROUP BY 1, 2), p AS (SELECT hash, CAST(sourceid // 4096 AS BIGINT) AS part, list_sort(list(sourceid)) AS doc_ids FROM d GROUP BY 1, 2), f AS (SELECT hash, count(sourceid) AS frequency, min(i) AS first_id FROM d GROUP BY 1) SELECT f.hash, frequency, part, doc_ids, first_id FROM f JOIN p ON p.hash IS NOT DISTINCT FROM f.hash")
def ag25(spark, sf):
    """Sentences rolled up by hash: the number of documents, the first id, and the documents in parts of bounded size, so a line of all documents fits."""
    d = table(spark, sf, "sentences").groupBy(F.md5(H).alias("hash"), "sourceid").agg(F.min("sentenceid").alias("i"))
    p = d.groupBy("hash", F.floor(F.col("sourceid") / 4096).alias("part")).agg(F.array_sort(F.collect_list("sourceid")).alias("doc_ids"))
    f = d.groupBy("hash").agg(F.count("sourceid").alias("frequency"), F.min("i").alias("first_id"))
    return f.join(p.withColumnRenamed("hash", "_h"), F.col("hash").eqNullSafe(F.col("_h"))).select("hash", "frequency", "part", "doc_ids", "first_id")


@op("ag26", f"SELECT sourceid, CAST(sum(wordcount) AS BIGINT) AS words, CAST(sum({ENTITY}) AS BIGINT) AS entities, max(CASE WHEN length({H})<40 THEN 0.5 ELSE 0.0 END)::DOUBLE AS boilerplate, count(*) AS n FROM sentences GROUP BY 1")
def ag26(spark, sf):
    """Documents rolled up from their sentences."""
    return table(spark, sf, "sentences").groupBy("sourceid").agg(
        F.sum("wordcount").alias("words"), F.sum(T.entity_count(F.col(H))).alias("entities"), F.max(F.when(F.length(H) < 40, 0.5).otherwise(0.0)).alias("boilerplate"), F.count("*").alias("n")
    )


both("ag27", "SELECT round(avg(wordcount), 6) AS wc, round(avg(length(hawaiiantext)), 6) AS len, count(*) AS n FROM {sentences}", "sentences")
both("ag28", "SELECT DISTINCT 'group' AS facet, groupname AS value FROM {sources} WHERE groupname IS NOT NULL UNION ALL SELECT DISTINCT 'author', authors FROM {sources} WHERE authors IS NOT NULL", "sources")


@op("ag29", "SELECT list_sort(list(DISTINCT status)) AS statuses, list_sort(list(DISTINCT operation_type)) AS operations, min(started_at) AS first_at, max(started_at) AS last_at, count(*) AS n FROM processing_log")
def ag29(spark, sf):
    return table(spark, sf, "processing_log").agg(
        F.array_sort(F.collect_set("status")).alias("statuses"), F.array_sort(F.collect_set("operation_type")).alias("operations"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"), F.count("*").alias("n")
    )


both("ag30", "SELECT DISTINCT sourceid FROM {sentences}", "sentences")
both("ag31", "SELECT 'sources' AS t, max(sourceid) AS m FROM {sources} UNION ALL SELECT 'sentences', max(sentenceid) FROM {sentences}", "sources", "sentences")


@op("ag32", f"SELECT 'total' AS pattern_type, count(*) AS n FROM {PATTERNS} p UNION ALL SELECT pattern_type, count(*) FROM {PATTERNS} p GROUP BY 1")
def ag32(spark, sf):
    c = ag12(spark, sf)
    return c.agg(F.lit("total").alias("pattern_type"), F.sum("n").alias("n")).unionByName(c)


@op("ag33", "SELECT CASE WHEN pattern IN ('any','all','exact') THEN pattern ELSE 'other' END AS action, count(*) AS n FROM searchstats GROUP BY 1")
def ag33(spark, sf):
    a = F.when(F.col("pattern").isin("any", "all", "exact"), F.col("pattern")).otherwise("other")
    return table(spark, sf, "searchstats").groupBy(a.alias("action")).agg(F.count("*").alias("n"))


@op("ag34", "SELECT trim(lower(translate(authors,'ōīēūāŌĪĒŪĀ‘ʻ''','oieuaOIEUA'))) AS name, count(*) AS n FROM sources WHERE authors IS NOT NULL GROUP BY 1")
def ag34(spark, sf):
    return table(spark, sf, "sources").where("authors IS NOT NULL").groupBy(T.normalize_word_marks(F.col("authors")).alias("name")).agg(F.count("*").alias("n"))


@op("ag35", "SELECT operation_type, count(*) AS n, round(sum(epoch(completed_at)-epoch(started_at)),3) AS total, round(avg(epoch(completed_at)-epoch(started_at)),3) AS mean FROM processing_log WHERE completed_at IS NOT NULL AND started_at IS NOT NULL GROUP BY 1")
def ag35(spark, sf):
    """Time by operation."""
    return A.timings(table(spark, sf, "processing_log"))

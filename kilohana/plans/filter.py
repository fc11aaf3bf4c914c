"""Projections, predicates and filters (PF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilohana.functions import text as T
from kilohana.operators import predicates as P
from kilohana.plans.text import TOK
from kilohana.plans.join import PATTERNS, patterns
from kilohana.registry import both, op
from kilohana.session import table

BLOCKED = ["hokuaohou", "leomakualani"]
_B = "'hokuaohou','leomakualani'"

both("pf01", "SELECT sourceid, sourcename, authors, link FROM {sources}", "sources")


@op("pf02", f"SELECT * FROM sources WHERE groupname NOT IN ({_B})")
def pf02(spark, sf):
    return table(spark, sf, "sources").where(P.not_blocked(F.col("groupname"), BLOCKED))


@op("pf03", f"SELECT sentenceid, sourceid FROM sentences WHERE sourceid NOT IN (SELECT sourceid FROM sources WHERE groupname IN ({_B}))")
def pf03(spark, sf):
    s = table(spark, sf, "sentences").select("sentenceid", "sourceid").where("sourceid IS NOT NULL")
    return P.drop_groups(s, table(spark, sf, "sources"), BLOCKED)


@op("pf04", f"SELECT sentenceid, sourceid FROM sentences WHERE sourceid IN (SELECT sourceid FROM sources WHERE groupname NOT IN ({_B}))")
def pf04(spark, sf):
    return P.keep_groups(table(spark, sf, "sentences").select("sentenceid", "sourceid"), table(spark, sf, "sources"), BLOCKED)


@op("pf05", "SELECT vec_id, round((1+list_cosine_similarity(embedding::DOUBLE[],(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0)))/2,6) AS score FROM embeddings WHERE label NOT IN (1,2) ORDER BY score DESC, vec_id LIMIT 10")
def pf05(spark, sf):
    """A filter of a nearest-neighbour search goes before the top k."""
    from kilohana.operators import vector as V

    e = table(spark, sf, "embeddings")
    return V.knn(e.where(~F.col("label").isin(1, 2)), V.query_vector(e), 10)


both("pf06", "SELECT sourceid, date FROM {sources} WHERE date BETWEEN DATE '1990-01-01' AND DATE '2010-12-31'", "sources")
both("pf07", "SELECT sourceid, authors FROM {sources} WHERE authors = 'Kalio Kakakanuʻe'", "sources")
both("pf08", "SELECT sourceid, date FROM {sources} WHERE date IS NOT NULL", "sources")
both("pf09", "SELECT sourceid FROM {contents} WHERE text IS NOT NULL AND octet_length(text) > 0", "contents", duck="SELECT sourceid FROM contents WHERE text IS NOT NULL AND strlen(text) > 0")
both("pf10", "SELECT d.doc_id FROM {documents} d LEFT JOIN (SELECT doc_id, max(grade) AS g FROM {reading_labels} GROUP BY doc_id) m ON m.doc_id = d.doc_id WHERE m.doc_id IS NULL OR m.g < 0", "documents", "reading_labels")
both("pf11", "SELECT sourceid, sourcename, link FROM {sources} WHERE link = 'http://hokuaohou.example/1001'", "sources")


@op("pf12", "SELECT sentenceid, hawaiiantext, sourcename FROM (SELECT DISTINCT sentenceid, sourceid, hawaiiantext FROM sentences WHERE sourceid=1001) t JOIN (SELECT sourceid, max(sourcename) AS sourcename FROM sources GROUP BY 1) s ON s.sourceid=t.sourceid ORDER BY sentenceid")
def pf12(spark, sf):
    """Sentences of one source in order, with the source's header."""
    s = table(spark, sf, "sentences").where("sourceid = 1001").select("sentenceid", "sourceid", "hawaiiantext").distinct()
    h = table(spark, sf, "sources").where("sourceid = 1001").groupBy("sourceid").agg(F.max("sourcename").alias("sourcename"))
    return s.join(F.broadcast(h), "sourceid").drop("sourceid").orderBy("sentenceid")  # h: one row


@op("pf13", "SELECT sourceid, sourcename FROM sources WHERE contains(lower(sourcename),'mahina') OR contains(lower(title),'mahina') OR contains(lower(authors),'mahina') OR contains(lower(groupname),'mahina')")
def pf13(spark, sf):
    return P.contains_any(table(spark, sf, "sources"), ["sourcename", "title", "authors", "groupname"], "Mahina").select("sourceid", "sourcename")


@op("pf14", r"SELECT sentenceid, CASE WHEN r>=0.5 THEN 'keep' WHEN r>=0.1 THEN 'mixed' ELSE 'english_only' END AS verdict FROM (SELECT sentenceid, len(list_filter(string_split_regex(lower(hawaiiantext),'\s+'), lambda x: regexp_matches(x,'^[aeiouhklmnpw]+$')))/len(string_split_regex(lower(hawaiiantext),'\s+')) AS r FROM sentences) t")
def pf14(spark, sf):
    """Gates on the share of Hawaiian words."""
    toks = F.split(F.lower("hawaiiantext"), r"\s+")
    r = F.size(F.filter(toks, lambda x: x.rlike("^[aeiouhklmnpw]+$"))) / F.size(toks)
    return table(spark, sf, "sentences").select("sentenceid", F.when(r >= 0.5, "keep").when(r >= 0.1, "mixed").otherwise("english_only").alias("verdict"))


@op("pf15", "SELECT sentenceid FROM sentences WHERE wordcount > 5 AND hawaiiantext LIKE 'Ua%'")
def pf15(spark, sf):
    """A clause given by a trusted caller."""
    return table(spark, sf, "sentences").where(F.expr("wordcount > 5 AND hawaiiantext LIKE 'Ua%'")).select("sentenceid")


@op("pf16", r"SELECT sentenceid FROM sentences WHERE strlen(hawaiiantext)>=20 AND NOT (regexp_matches(hawaiiantext,'^[^a-z]*$') AND regexp_matches(hawaiiantext,'[A-Z]')) AND NOT regexp_matches(hawaiiantext,'^(?:Page|ʻAoao|Chapter)\s') AND NOT regexp_matches(hawaiiantext,'^[\d\s.,]+$')")
def pf16(spark, sf):
    return table(spark, sf, "sentences").where(P.good_content(F.col("hawaiiantext"))).select("sentenceid")


@op("pf17", "SELECT DISTINCT sentenceid, 'quoted' AS term FROM sentences WHERE contains(' ' || array_to_string(list_filter(string_split_regex(lower(hawaiiantext),'[^\\p{L}\\p{N}]+'), lambda x: x<>''),' ') || ' ', ' ka hale ')")
def pf17(spark, sf):
    """Guards of a term: a blank one finds nothing, quotes around one go."""
    from kilohana.operators import search as S

    out = None
    for name, term in (("blank", "  "), ("quotes only", '""'), ("quoted", '"ka hale"')):
        t = S.guarded(term)
        hit = S.search(table(spark, sf, "sentences"), "phrase", t) if t else table(spark, sf, "sentences").where("false")
        x = hit.select("sentenceid", F.lit(name).alias("term")).distinct()
        out = x if out is None else out.unionByName(x)
    return out


@op("pf18", "SELECT DISTINCT sentenceid, hawaiiantext FROM sentences WHERE regexp_matches(lower(hawaiiantext),'ka hale')")
def pf18(spark, sf):
    """A quoted phrase must occur as it is."""
    return table(spark, sf, "sentences").where(F.col("hawaiiantext").rlike("(?i)ka hale")).select("sentenceid", "hawaiiantext").distinct()


both("pf19", "SELECT sourceid FROM {contents} WHERE html IS NOT NULL AND text IS NOT NULL AND text <> ''", "contents")


@op("pf20", f"SELECT DISTINCT sentenceid FROM sentences WHERE sentenceid NOT IN (SELECT sentenceid FROM {PATTERNS} p WHERE sentenceid IS NOT NULL)")
def pf20(spark, sf):
    """Rows without any grammar pattern: an anti-join of those that have one."""
    s = table(spark, sf, "sentences")
    return s.select("sentenceid").distinct().join(patterns(spark, sf).select("sentenceid"), "sentenceid", "left_anti")


@op("pf21", "SELECT log_id, operation_type, status, started_at FROM processing_log WHERE status='failed' AND started_at >= TIMESTAMP '2016-01-01 10:00:00' AND started_at < TIMESTAMP '2027-01-01 10:00:00' ORDER BY started_at, log_id LIMIT 100")
def pf21(spark, sf):
    """The processing log by status and local-time bounds, in order of time since there is a lower bound."""
    return P.log_page(table(spark, sf, "processing_log"), status="failed", start="2016-01-01", end="2027-01-01").select("log_id", "operation_type", "status", "started_at")

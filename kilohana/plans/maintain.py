"""Mutations and sinks (SK): each query gives the table's new state, or what is appended to it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from kilohana.functions import text as T
from kilohana.operators import grammar as G
from kilohana.operators import maintain as M
from kilohana.plans.join import PATTERNS
from kilohana.plans.search import SENTS, sents
from kilohana.registry import both, op
from kilohana.session import table
from kilohana.sources import readers

H = "hawaiiantext"


@op("sk01", "SELECT link, title, groupname, coalesce(date, DATE '1970-01-01') AS date FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY created DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM sources WHERE link IS NOT NULL AND groupname IS NOT NULL AND title IS NOT NULL) t WHERE rn=1")
def sk01(spark, sf):
    """Sources by link, the latest wins; link, group and title are required; a missing date is the epoch."""
    s = table(spark, sf, "sources").where("link IS NOT NULL AND groupname IS NOT NULL AND title IS NOT NULL")
    s = M.latest(s, ["link"], F.desc_nulls_last("created"), F.desc_nulls_last("title"))
    return s.select("link", "title", "groupname", F.coalesce("date", F.lit("1970-01-01").cast("date")).alias("date"))


@op("sk02", "SELECT DISTINCT trim(hawaiiantext) AS t FROM sentences WHERE strlen(trim(hawaiiantext))>=3 AND trim(hawaiiantext) NOT IN (SELECT hawaiiantext FROM sentences WHERE sourceid=1001)")
def sk02(spark, sf):
    """Sentences added: trimmed, three bytes or more, new ones only."""
    s = table(spark, sf, "sentences")
    new = s.select(F.trim(H).alias("t")).where(F.octet_length("t") >= 3)
    return M.insert_ignore(s.where("sourceid = 1001").select(F.col(H).alias("t")), new, ["t"])


@op("sk03", rf"SELECT sourceid, sentenceid // {readers.PART} AS part, string_agg(trim(regexp_replace(hawaiiantext,'[\x00-\x1F\x7F]','','g')), chr(10) ORDER BY sentenceid, trim(regexp_replace(hawaiiantext,'[\x00-\x1F\x7F]','','g'))) AS text FROM " + SENTS + " GROUP BY 1, 2")
def sk03(spark, sf):
    """Full text of a source from its sentences, in parts of bounded size."""
    s = sents(spark, sf).select("sourceid", "sentenceid", F.trim(T.strip_control(F.col(H))).alias("t"))
    return readers.in_parts(s, "sourceid", "sentenceid", "t", "\n")


@op("sk04", "WITH l AS (SELECT sourceid, html, text FROM (SELECT *, row_number() OVER (PARTITION BY sourceid ORDER BY created DESC NULLS LAST, html DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM contents) t WHERE rn=1) SELECT sourceid, length(html) AS h, length(text) AS t FROM l")
def sk04(spark, sf):
    """Raw and plain text by source, the last delivery."""
    l = M.latest(table(spark, sf, "contents"), ["sourceid"], F.desc_nulls_last("created"), F.desc_nulls_last("html"), F.desc_nulls_last("text"))
    return l.select("sourceid", F.length("html").alias("h"), F.length("text").alias("t"))


both("sk05", "SELECT sentenceid, sourceid FROM {sentences} WHERE NOT (sourceid <=> 1001)", "sentences", duck="SELECT sentenceid, sourceid FROM sentences WHERE sourceid IS DISTINCT FROM 1001")


@op("sk06", "SELECT 'sources' AS t, count(*) AS n FROM sources WHERE groupname='makanimalie' UNION ALL SELECT 'contents', count(*) FROM contents WHERE sourceid IN (SELECT sourceid FROM sources WHERE groupname='makanimalie') UNION ALL SELECT 'sentences', count(*) FROM sentences WHERE sourceid IN (SELECT sourceid FROM sources WHERE groupname='makanimalie')")
def sk06(spark, sf):
    """What deleting a group takes from each table."""
    src = table(spark, sf, "sources").where("groupname = 'makanimalie'")
    out = src.agg(F.lit("sources").alias("t"), F.count("*").alias("n"))
    for t in ("contents", "sentences"):
        out = out.unionByName(M.keep_where_in(table(spark, sf, t), src, "sourceid").agg(F.lit(t).alias("t"), F.count("*").alias("n")))
    return out


@op("sk07", "WITH n AS (SELECT doc_id, max(grade) AS grade FROM reading_labels GROUP BY 1), o AS (SELECT doc_id, 0::BIGINT AS grade FROM documents) SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def sk07(spark, sf):
    """Metrics upserted."""
    new = table(spark, sf, "reading_labels").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    old = table(spark, sf, "documents").select("doc_id", F.lit(0).cast("long").alias("grade"))
    return M.upsert(old, new, ["doc_id"])


@op("sk08", "SELECT d.doc_id, coalesce(g.grade, d.n_chars) AS n_chars FROM (SELECT doc_id, n_chars FROM documents) d LEFT JOIN (SELECT doc_id, max(grade) AS grade FROM reading_labels GROUP BY 1) g ON g.doc_id=d.doc_id")
def sk08(spark, sf):
    """A staged column over the stored one."""
    st = table(spark, sf, "reading_labels").groupBy("doc_id").agg(F.max("grade").alias("n_chars"))
    return M.update_columns(table(spark, sf, "documents").select("doc_id", "n_chars"), st, "doc_id", ["n_chars"])


@op("sk09", f"SELECT DISTINCT sentenceid, pattern_type FROM {PATTERNS} p WHERE pattern_type<>'pepeke_henua'")
def sk09(spark, sf):
    """Patterns appended where the pair is new."""
    p = G.scan(table(spark, sf, "sentences")).select("sentenceid", "pattern_type")
    return M.insert_ignore(p.where("pattern_type = 'pepeke_henua'"), p, ["sentenceid", "pattern_type"])


both("sk10", "SELECT s.sentenceid FROM {sentences} s LEFT SEMI JOIN (SELECT sourceid FROM {contents} WHERE text IS NOT NULL) c ON c.sourceid = s.sourceid", "sentences", "contents", duck="SELECT sentenceid FROM sentences WHERE sourceid IN (SELECT sourceid FROM contents WHERE text IS NOT NULL)")


@op("sk11", "SELECT d.doc_id, coalesce(u.title, d.title) AS title FROM documents d LEFT JOIN (SELECT doc_id, upper(title) AS title FROM documents WHERE medium='oral') u ON u.doc_id=d.doc_id")
def sk11(spark, sf):
    """A partial update: only what it names changes."""
    d = table(spark, sf, "documents")
    return M.update_columns(d.select("doc_id", "title"), d.where("medium = 'oral'").select("doc_id", F.upper("title").alias("title")), "doc_id", ["title"])


@op("sk12", "WITH f AS (SELECT DISTINCT link FROM documents WHERE link IS NOT NULL AND link NOT IN (SELECT link FROM sources WHERE link IS NOT NULL)) SELECT (SELECT max(sourceid) FROM sources) + row_number() OVER (ORDER BY link) AS sourceid, link FROM f")
def sk12(spark, sf):
    """Ids for new links after the largest there is."""
    new = table(spark, sf, "documents").where("link IS NOT NULL").select("link")
    return M.allocate_ids(table(spark, sf, "sources").where("link IS NOT NULL").select("sourceid", "link"), new, "sourceid", "link").select("sourceid", "link")


@op("sk13", "SELECT coalesce(searchterm,'') AS searchterm, coalesce(results,0) AS results, coalesce(lower(pattern),'any') AS pattern, coalesce(elapsed,0.0) AS elapsed FROM searchstats")
def sk13(spark, sf):
    """Query log rows as they are stored: missing values get their defaults."""
    s = table(spark, sf, "searchstats")
    return s.select(F.coalesce("searchterm", F.lit("")).alias("searchterm"), F.coalesce("results", F.lit(0)).alias("results"), F.coalesce(F.lower("pattern"), F.lit("any")).alias("pattern"), F.coalesce("elapsed", F.lit(0.0)).alias("elapsed"))


@op("sk14", "SELECT log_id, CASE WHEN completed_at IS NULL THEN 'running' WHEN error_message IS NOT NULL THEN 'failed' ELSE 'completed' END AS state, CASE WHEN completed_at IS NULL OR error_message IS NOT NULL THEN 0 ELSE coalesce(sentences_count,0) END AS n FROM processing_log")
def sk14(spark, sf):
    """The state a logged operation ended in, and its count."""
    state = F.when(F.col("completed_at").isNull(), "running").when(F.col("error_message").isNotNull(), "failed").otherwise("completed")
    return table(spark, sf, "processing_log").select("log_id", state.alias("state"), F.when(state == "completed", F.coalesce("sentences_count", F.lit(0))).otherwise(0).alias("n"))


@op("sk15", "SELECT DISTINCT s.sourceid, s.link FROM sources s WHERE s.sourceid NOT IN (SELECT sourceid FROM contents)")
def sk15(spark, sf):
    """What a migration still has to copy."""
    s = table(spark, sf, "sources").select("sourceid", "link").distinct()
    return M.delete_where_in(s, table(spark, sf, "contents"), "sourceid")


@op("sk16", "SELECT word, action FROM (SELECT lower(searchterm) AS word, pattern AS action, row_number() OVER (PARTITION BY lower(searchterm) ORDER BY created DESC NULLS LAST, pattern DESC NULLS LAST) AS rn FROM searchstats WHERE searchterm IS NOT NULL) t WHERE rn=1 AND word <> 'hale'")
def sk16(spark, sf):
    """Overrides: the last entry of a word wins, a removed word is gone."""
    s = table(spark, sf, "searchstats").where("searchterm IS NOT NULL").select(F.lower("searchterm").alias("word"), F.col("pattern").alias("action"), "created")
    return M.latest(s, ["word"], F.desc_nulls_last("created"), F.desc_nulls_last("action")).where("word <> 'hale'").select("word", "action")


@op("sk20", f"SELECT pattern_type, count(*) AS n FROM {PATTERNS} p GROUP BY 1")
def sk20(spark, sf):
    """A table written anew and read back."""
    path = os.path.join(readers.work_dir(spark), "patterns")
    G.scan(table(spark, sf, "sentences")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("pattern_type").agg(F.count("*").alias("n"))


_ESC = "replace(replace(replace(replace({c},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;')"


@op("sk21", f"""SELECT sourceid, 'json' AS kind, CAST(to_json({{'sourceid': sourceid, 'sourcename': sourcename, 'link': link}}) AS VARCHAR) AS line FROM (SELECT DISTINCT sourceid, coalesce(sourcename,'') AS sourcename, coalesce(link,'') AS link FROM sources) a
UNION ALL SELECT sourceid, 'html', '<li><a href="' || {_ESC.format(c='link')} || '">' || {_ESC.format(c='sourcename')} || '</a></li>' FROM (SELECT DISTINCT sourceid, coalesce(sourcename,'') AS sourcename, coalesce(link,'') AS link FROM sources) b
UNION ALL SELECT sourceid, 'cli', lpad(CAST(sourceid AS VARCHAR), 8, ' ') || '  ' || sourcename || chr(10) || '          ' || link FROM (SELECT DISTINCT sourceid, coalesce(sourcename,'') AS sourcename, coalesce(link,'') AS link FROM sources) c""")
def sk21(spark, sf):
    """Sources rendered three ways: JSON lines for a REST client, list items for a page, two lines for a terminal."""
    s = table(spark, sf, "sources").select("sourceid", F.coalesce("sourcename", F.lit("")).alias("sourcename"), F.coalesce("link", F.lit("")).alias("link")).distinct()
    return M.rendered(s, "sourceid", "sourcename", "link")


both("sk22", "SELECT o.sourceid, count(s.sentenceid) AS sentencecount, count(s.sentenceid) < 1 AS discarded, CAST(1.0 AS DOUBLE) AS quality FROM (SELECT DISTINCT sourceid FROM {sources}) o LEFT JOIN {sentences} s ON s.sourceid = o.sourceid GROUP BY o.sourceid", "sources", "sentences")


@op("sk23", f"SELECT s.sentenceid, coalesce(p.t, []) AS grammar_patterns FROM (SELECT DISTINCT sentenceid FROM sentences) s LEFT JOIN (SELECT sentenceid, list_sort(list(DISTINCT pattern_type)) AS t FROM {PATTERNS} p GROUP BY 1) p ON p.sentenceid=s.sentenceid")
def sk23(spark, sf):
    """Pattern types as an array on each sentence; one pass, no join."""
    return table(spark, sf, "sentences").select("sentenceid", H).distinct().select("sentenceid", F.array_sort(G.types(F.col(H))).alias("grammar_patterns"))


@op("sk24")
def sk24(spark, sf):
    """Missing vectors filled in for every text without one, by a pluggable function (a local one here); those that are there stay."""
    from kilohana.operators.embed import hashed_embedding

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text").join(e, "doc_id", "left")
    return d.select("doc_id", F.coalesce("embedding", hashed_embedding(F.col("text"), 64)).alias("embedding"))


@op("sk25", "WITH n AS (SELECT sourceid, max(title) AS title FROM sources GROUP BY 1), o AS (SELECT sourceid, NULL::VARCHAR AS title FROM contents GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE sourceid NOT IN (SELECT sourceid FROM n)")
def sk25(spark, sf):
    """A store copied over another by primary key."""
    new = table(spark, sf, "sources").groupBy("sourceid").agg(F.max("title").alias("title"))
    old = table(spark, sf, "contents").select("sourceid", F.lit(None).cast("string").alias("title")).distinct()
    return M.upsert(old, new, ["sourceid"])


@op("sk26", "SELECT sentenceid FROM sentences WHERE sourceid IN (SELECT sourceid FROM sources WHERE link IS NOT NULL)")
def sk26(spark, sf):
    """Orphans deleted."""
    return M.keep_where_in(table(spark, sf, "sentences"), table(spark, sf, "sources").where("link IS NOT NULL"), "sourceid").select("sentenceid")


@op("sk27", "SELECT sentenceid FROM sentences WHERE sourceid NOT IN (SELECT sourceid FROM sources WHERE groupname='kahuanupepa')")
def sk27(spark, sf):
    """A group deleted from the sentences."""
    s = table(spark, sf, "sentences").where("sourceid IS NOT NULL")
    return M.delete_where_in(s, table(spark, sf, "sources").where("groupname = 'kahuanupepa'"), "sourceid").select("sentenceid")


both("sk28", "SELECT sourceid FROM {contents} WHERE html IS NOT NULL", "contents", doc="Documents without a field deleted.")


@op("sk29", "SELECT DISTINCT trim(line) AS line FROM (SELECT unnest(string_split(text,chr(10))) AS line FROM contents) t WHERE strlen(trim(line))>=3")
def sk29(spark, sf):
    """Lines of a posted text become sentences."""
    c = table(spark, sf, "contents").select(F.explode(F.split("text", "\n")).alias("line"))
    return c.select(F.trim("line").alias("line")).where(F.octet_length("line") >= 3).distinct()


@op("sk30", "SELECT sentenceid, coalesce(CASE WHEN sentenceid % 2=0 THEN 'kept' END, md5(hawaiiantext)) AS hash FROM sentences")
def sk30(spark, sf):
    """Hashes only where there is none."""
    have = F.when(F.col("sentenceid") % 2 == 0, "kept")
    return table(spark, sf, "sentences").select("sentenceid", F.coalesce(have, F.md5(H)).alias("hash"))


def _fingerprint_sql() -> str:
    """Markers of several words one after the other, each used up; then the single ones; in DuckDB."""
    q = rf"SELECT sentenceid, regexp_replace(lower(trim({H})),'[^\\p{{L}}\\p{{M}}\\p{{N}}_\\sʻ]','','g') AS r0 FROM sentences".replace("\\\\", "\\")
    cols = []
    for i, m in enumerate(G.MULTI):
        q = f"SELECT *, CASE WHEN contains(r{i},'{m}') THEN '{m.replace(' ', '_')}' END AS f{i}, replace(r{i},'{m}',' ') AS r{i + 1} FROM ({q})"
        cols.append(f"f{i}")
    n = len(G.MULTI)
    single = "list_filter(regexp_extract_all(r%d,'[\\p{L}\\p{M}\\p{N}_]+'), lambda x: x IN (%s))" % (n, ",".join(f"'{x}'" for x in G.MARKERS))
    e = f"array_to_string(list_concat(list_filter([{','.join(cols)}], lambda x: x IS NOT NULL), {single}),'-')"
    return f"SELECT sentenceid, CASE WHEN r0 IS NULL OR {e}='' THEN 'plain' ELSE {e} END AS v FROM ({q})"


@op("sf30", _fingerprint_sql())
def sf30(spark, sf):
    """The grammar fingerprint of every sentence; a null text has none of the markers."""
    return table(spark, sf, "sentences").select("sentenceid", F.coalesce(G.fingerprint(F.col(H)), F.lit("plain")).alias("v"))


@op("sf31", f"SELECT sentenceid, sourceid, pattern_type FROM {PATTERNS} p")
def sf31(spark, sf):
    """The pattern scan."""
    return G.scan(table(spark, sf, "sentences")).select("sentenceid", "sourceid", "pattern_type")

"""Scans and sources (SC)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kilohana.operators.grammar import RULES
from kilohana.plans.text import fold_sql
from kilohana.registry import both, op
from kilohana.session import table
from kilohana.sources import readers

both("sc01", "SELECT sourceid, sourcename, groupname FROM {sources}", "sources")
both("sc02", "SELECT sentenceid, sourceid, hawaiiantext FROM {sentences}", "sentences")
both("sc03", "SELECT doc_id, title, lang FROM {documents}", "documents")
both("sc04", "SELECT doc_id FROM {documents}", "documents")


@op("sc05", "SELECT sentenceid, hawaiiantext FROM (SELECT DISTINCT sentenceid, hawaiiantext FROM sentences) t WHERE sentenceid > 5000 ORDER BY sentenceid LIMIT 100")
def sc05(spark, sf):
    """Keyset page: the filter reaches the scan, the limit is a take-ordered."""
    return readers.keyset_page(table(spark, sf, "sentences").select("sentenceid", "hawaiiantext").distinct(), "sentenceid", 5000, 100)


@op("sc06", "SELECT DISTINCT sourceid FROM sources ORDER BY sourceid LIMIT 50 OFFSET 100")
def sc06(spark, sf):
    return readers.offset_page(table(spark, sf, "sources").select("sourceid").distinct(), ["sourceid"], 100, 50)


both("sc07", "SELECT sentenceid, hawaiiantext FROM {sentences} WHERE sentenceid > 2000 AND sentenceid <= 7000", "sentences")
both("sc08", "SELECT sourceid, sourcename, groupname, title FROM {sources} WHERE groupname = 'hokuaohou'", "sources")


@op("sc09", "SELECT c.sourceid, s.link, coalesce(c.html,'') AS html FROM (SELECT DISTINCT sourceid, link FROM sources) s JOIN contents c ON c.sourceid = s.sourceid")
def sc09(spark, sf):
    """A page fetch: the stored page of a link, '' where nothing came."""
    s = table(spark, sf, "sources").select("sourceid", "link").distinct()
    return table(spark, sf, "contents").join(s, "sourceid").select("sourceid", "link", F.coalesce("html", F.lit("")).alias("html"))


_HOST = r"regexp_extract(base,'^(https?://[^/]+)',1)"
_LINK = r'(?i)<a\b[^>]*\bhref\s*=\s*"([^"#]+)"[^>]*>([^<]*)'


@op("sc10", rf"""WITH s AS (SELECT DISTINCT sourceid, link AS base FROM sources WHERE link IS NOT NULL),
p AS (SELECT s.base, regexp_extract_all(c.html,'{_LINK}',1) AS h, regexp_extract_all(c.html,'{_LINK}',2) AS t FROM s JOIN contents c ON c.sourceid=s.sourceid WHERE c.html IS NOT NULL),
l AS (SELECT base, unnest(h) AS h, unnest(t) AS t FROM p),
u AS (SELECT base, CASE WHEN regexp_matches(h,'^https?://') THEN h WHEN starts_with(h,'/') THEN {_HOST}||h ELSE {_HOST}||'/'||h END AS url, regexp_replace(trim(t),'^(?:Column:\s*|By na |By |Na )','') AS title FROM l)
SELECT base, url, min(title) AS title, try_cast(replace(nullif(regexp_extract(url,'/(\d{{4}}/\d{{2}}/\d{{2}})/',1),''),'/','-') AS DATE) AS date FROM u GROUP BY base, url""")
def sc10(spark, sf):
    """Catalogue crawl over stored pages: their links, absolute, each once with its least title, and the date of the address."""
    s = table(spark, sf, "sources").where("link IS NOT NULL").select("sourceid", F.col("link").alias("base")).distinct()
    return readers.catalogue(table(spark, sf, "contents").join(s, "sourceid").select("base", "html"))


_HEAD = r"regexp_extract(html,'(?is)<head\b[^>]*>.*?</head\s*>',0)"


@op("sc11", rf"""WITH g AS (SELECT sourceid, max(groupname) AS groupname FROM sources GROUP BY 1),
p AS (SELECT DISTINCT c.sourceid, g.groupname, c.sourceid // 256 AS part, html FROM contents c JOIN g ON g.sourceid=c.sourceid WHERE html IS NOT NULL AND groupname IS NOT NULL)
SELECT groupname, part, count(*) AS pages, md5('<html>' || coalesce(nullif(arg_min({_HEAD}, (sourceid, html)),''),'<head><meta charset="UTF-8"></head>') || '<body>' || string_agg(regexp_extract(html,'(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)',1), '' ORDER BY sourceid, html) || '</body></html>') AS h FROM p GROUP BY 1, 2""")
def sc11(spark, sf):
    """Pages of one work merged: the first page's head, the bodies in order. A work's pages come in parts of 256 ids, so no row grows with the work."""
    s = table(spark, sf, "sources").groupBy("sourceid").agg(F.max("groupname").alias("groupname")).where("groupname IS NOT NULL")
    c = table(spark, sf, "contents").where("html IS NOT NULL").select("sourceid", "html").distinct().join(s, "sourceid")
    return readers.merged_pages(c.withColumn("part", F.floor(F.col("sourceid") / 256)), "groupname", "part", "sourceid").select("groupname", "part", "pages", F.md5("html").alias("h"))


_WORD = "trim(" + "translate({c},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')".format(c=fold_sql("w")) + ")"


@op("sc12", rf"SELECT DISTINCT {_WORD} AS word FROM (SELECT unnest(string_split_regex(title,'[\n, ]+')) AS w FROM sources WHERE title IS NOT NULL) t WHERE {_WORD} NOT IN ('','a','i')")
def sc12(spark, sf):
    """A word list from lines, commas and spaces: normalised, each once, without the two one-letter words."""
    return readers.word_list(table(spark, sf, "sources").where("title IS NOT NULL").select(F.col("title").alias("line")))


_NAME = "trim(lower(translate({c},'ōīēūāŌĪĒŪĀ‘ʻ''','oieuaOIEUA')))"


@op("sc13", f"""SELECT {_NAME.format(c='x')} AS name, sum(n)::BIGINT AS n FROM (
SELECT authors AS x, count(*) AS n FROM sources WHERE authors IS NOT NULL GROUP BY 1 UNION ALL SELECT DISTINCT groupname, 1 FROM sources WHERE groupname IS NOT NULL
UNION ALL SELECT DISTINCT title, 1 FROM sources WHERE title IS NOT NULL UNION ALL SELECT DISTINCT lower(searchterm), 1 FROM searchstats WHERE length(trim(searchterm))>2) t WHERE trim(x)<>'' GROUP BY 1""")
def sc13(spark, sf):
    """Name lists in four formats (numbers in a zip, wiki table rows, JSON features, one word a line), written, read, and summed per normalised name."""
    base = readers.work_dir(spark)
    src = table(spark, sf, "sources")
    names = src.where("authors IS NOT NULL").groupBy("authors").count()
    names.select(F.concat_ws(",", "authors", F.lit("F"), F.col("count").cast("string")).alias("value")).write.text(f"{base}/plain")
    readers.zip_texts(spark, f"{base}/plain", f"{base}/zip")
    src.where("groupname IS NOT NULL").select("groupname").distinct().select(F.concat(F.lit("|| [["), "groupname", F.lit("]] || he inoa")).alias("value")).write.text(f"{base}/wiki")
    src.where("title IS NOT NULL").select("title").distinct().select(F.array(F.struct(F.struct(F.col("title").alias("NAME"), F.lit("Locale").alias("FEATURE_CLASS")).alias("attributes"))).alias("features")).write.json(f"{base}/features")
    table(spark, sf, "searchstats").where("searchterm IS NOT NULL").select(F.lower("searchterm").alias("value")).distinct().write.text(f"{base}/words")
    lists = readers.zipped_csv(spark, f"{base}/zip").unionByName(readers.wikitext_names(spark.read.text(f"{base}/wiki")))
    lists = lists.unionByName(readers.feature_names(spark, f"{base}/features", multi=False)).unionByName(readers.listed_words(spark.read.text(f"{base}/words")))
    return readers.name_counts(lists.where("trim(name) <> ''"))


_T = "(SELECT DISTINCT searchterm AS w FROM searchstats WHERE searchterm IS NOT NULL AND trim(searchterm) <> '')"


@op("sc14", f"""SELECT k AS word, arg_max(action, (f, w)) AS action, arg_max(category, (f, w)) AS category FROM (
SELECT {_NAME.format(c='w')} AS k, w, 1 AS f, CASE WHEN length(w)%2=0 THEN 'include' ELSE 'review' END AS action, CASE WHEN length(w)%2=0 THEN 'place' ELSE '' END AS category FROM {_T} a WHERE length(w)%3<>0
UNION ALL SELECT {_NAME.format(c='w')}, w, 2, 'stopword', '' FROM {_T} b WHERE length(w)%3=0
UNION ALL SELECT {_NAME.format(c='w')}, w, 3, 'include', 'kept' FROM {_T} c WHERE length(w)%5=0) t WHERE k <> '' GROUP BY 1""")
def sc14(spark, sf):
    """Override files of three shapes, made of the search terms; keys normalised, the later file and place win."""
    base = readers.work_dir(spark)
    w = table(spark, sf, "searchstats").where("searchterm IS NOT NULL AND trim(searchterm) <> ''").select(F.col("searchterm").alias("w")).distinct()
    n = F.length("w")
    entry = F.struct(F.col("w").alias("word"), F.when(n % 2 == 0, "Include ").alias("action"), F.when(n % 2 == 0, "place").alias("category"))
    terms = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("w"))))  # noqa: E731  one file is one JSON document, as the shapes ask
    parts = {
        "1": w.agg(F.array_sort(F.collect_set(F.when(n % 3 != 0, entry))).alias("entries")),
        "2": w.agg(terms(n % 3 == 0).alias("stopwords")),
        "3": w.agg(F.map_from_entries(F.transform(terms(n % 5 == 0), lambda x: F.struct(x, F.lit("kept")))).alias("recategorized")),
    }
    rows = None
    for name, d in parts.items():
        d.write.json(f"{base}/{name}")
        r = readers.override_files(spark, f"{base}/{name}").withColumn("file", F.lit(name))
        rows = r if rows is None else rows.unionByName(r)
    return readers.overrides(rows)


_RULES = "(VALUES " + ", ".join("(" + ",".join("'" + x.replace("'", "''") + "'" for x in (t, "(?iuU)" + rx, sig)) + ")" for t, sig, rx in RULES) + ") t(pattern_type, regex, signature)"


@op("sc15", f"SELECT * FROM {_RULES}")
def sc15(spark, sf):
    """The grammar rules as a table, with the flags for case and Unicode."""
    from kilohana.operators.grammar import rules

    return rules(spark)


@op("sc16", r"SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS h, regexp_extract(text,'\b((?:19|20)\d{2})\b',1) AS year, coalesce(title,'') AS title FROM documents WHERE text IS NOT NULL")
def sc16(spark, sf):
    """Whole texts written and read with their line breaks, joined with their metadata file; the year is the first that a text shows."""
    base = readers.work_dir(spark)
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    readers.write_texts(d.select("doc_id", "text"), f"{base}/texts")
    d.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("title", F.lit("")).alias("title")).write.json(f"{base}/metadata")
    x = readers.read_texts(spark, f"{base}/texts")
    year = F.regexp_extract("text", r"(?<![A-Za-z0-9_])((?:19|20)\d{2})(?![A-Za-z0-9_])", 1)
    return x.join(spark.read.json(f"{base}/metadata", schema="id string, title string"), "id").select("id", F.md5("text").alias("h"), year.alias("year"), "title")


@op("sc17", f"""WITH c AS (SELECT sourceid, max(text) AS t FROM contents GROUP BY 1), s AS (SELECT DISTINCT sourceid FROM sources),
j AS (SELECT sourceid, sentenceid // {readers.PART} AS part, string_agg(hawaiiantext, ' ' ORDER BY sentenceid, hawaiiantext) AS t FROM (SELECT DISTINCT sourceid, sentenceid, hawaiiantext FROM sentences) q GROUP BY 1, 2)
SELECT s.sourceid, 0 AS part, c.t AS text FROM s JOIN c ON c.sourceid=s.sourceid WHERE c.t IS NOT NULL
UNION ALL SELECT s.sourceid, j.part, j.t FROM s JOIN j ON j.sourceid=s.sourceid WHERE s.sourceid NOT IN (SELECT sourceid FROM c WHERE t IS NOT NULL AND sourceid IS NOT NULL)""")
def sc17(spark, sf):
    """Plain text of a source: the stored text, else its sentences in order, in parts of bounded size."""
    c = table(spark, sf, "contents").groupBy("sourceid").agg(F.max("text").alias("text")).where("text IS NOT NULL")
    s = table(spark, sf, "sources").select("sourceid").distinct()
    d = table(spark, sf, "sentences").select("sourceid", "sentenceid", "hawaiiantext").distinct().join(s, "sourceid", "left_semi").join(c.select("sourceid"), "sourceid", "left_anti")
    return s.join(c, "sourceid").select("sourceid", F.lit(0).cast("long").alias("part"), "text").unionByName(readers.in_parts(d, "sourceid", "sentenceid", "hawaiiantext", " "))


@op("sc18", "SELECT * FROM (VALUES ('v1', true, 'v1', (SELECT count(*) FROM sources)), ('alias', true, 'v1', (SELECT count(*) FROM sources)), ('alias moved', true, 'v2', (SELECT count(DISTINCT sourceid) FROM sources)), ('v1 removed', false, NULL, 0), ('never', false, NULL, 0)) t(step, found, stands_for, n)")
def sc18(spark, sf):
    """The life of an index: created, aliased, the alias moved to a new version, the old version removed."""
    tag = f"k{uuid.uuid4().hex[:8]}"
    v1, v2, live = f"{tag}_v1", f"{tag}_v2", f"{tag}_live"
    a = readers.Aliases(spark)
    src = table(spark, sf, "sources")
    rows = []

    def say(step, name):
        to = a.resolve(name)
        rows.append((step, a.exists(name), to.split("_")[1] if to else None, spark.table(name).count() if to else 0))

    a.create(v1, src)
    say("v1", v1)
    a.point(live, v1)
    say("alias", live)
    a.create(v2, src.dropDuplicates(["sourceid"]))
    a.point(live, v2)
    say("alias moved", live)
    a.remove(v1)
    say("v1 removed", v1)
    say("never", f"{tag}_none")
    for name in (live, v2):
        a.remove(name)
    return spark.createDataFrame(rows, "step string, found boolean, stands_for string, n long")

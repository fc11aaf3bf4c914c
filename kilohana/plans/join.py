"""Joins (JN), set operations (SO), sorts and limits (ST)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kilohana.functions import text as T
from kilohana.operators import grammar as G
from kilohana.operators import vector as V
from kilohana.plans.search import SENTS, sents
from kilohana.registry import both, op
from kilohana.session import table

both("jn01", "SELECT s.sentenceid, s.sourceid, o.groupname FROM {sentences} s JOIN {sources} o ON o.sourceid = s.sourceid", "sentences", "sources")


def pattern_sql(extra: str = "") -> str:
    """The pattern scan in DuckDB: Unicode word characters and boundaries spelled out."""
    out = []
    for t, s, rx in G.RULES:
        space = r"\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}"
        word = r"0-9A-Za-z_\x{c0}-\x{24f}\x{2b0}-\x{36f}\x{370}-\x{52f}\x{200c}\x{200d}\x{3040}-\x{9fff}\x{ff10}-\x{ff5a}"
        d = rx.replace(r"[\w", "[" + word).replace("'", "''").replace(r"[\s", "[" + "\0").replace(r"\s", f"[{space}]").replace("\0", space)
        if d.startswith(r"\b"):
            d = f"(?:^|[^{word}])" + d[2:]
        if d.endswith(r"\b"):
            d = d[:-2] + f"(?:$|[^{word}])"
        out.append(f"SELECT sentenceid, sourceid, '{t}' AS pattern_type FROM sentences WHERE regexp_matches(hawaiiantext,'(?i){d}'){extra}")
    return "(" + " UNION ALL ".join(out) + ")"


PATTERNS = pattern_sql()


def patterns(spark, sf):
    return G.scan(table(spark, sf, "sentences")).select("sentenceid", "sourceid", "pattern_type")


@op("jn02", f"SELECT p.pattern_type, p.sentenceid, o.title FROM {PATTERNS} p JOIN sources o ON o.sourceid=p.sourceid WHERE p.pattern_type='pepeke_nonoa'")
def jn02(spark, sf):
    """Patterns, their sentences and sources."""
    p = patterns(spark, sf).where("pattern_type = 'pepeke_nonoa'")
    return p.join(table(spark, sf, "sources").select("sourceid", "title"), "sourceid").select("pattern_type", "sentenceid", "title")


both("jn03", "SELECT o.sourceid, count(s.sentenceid) AS n FROM {sources} o LEFT JOIN {sentences} s ON s.sourceid = o.sourceid GROUP BY o.sourceid HAVING count(s.sentenceid) > 0", "sources", "sentences")
both("jn04", "SELECT o.sourceid, count(*) AS n FROM {sources} o LEFT JOIN {sentences} s ON s.sourceid = o.sourceid GROUP BY o.sourceid", "sources", "sentences", doc="count(*) of a left join: 1 for a source without sentences.")


@op("jn05", f"SELECT q.sentenceid, x.title FROM (SELECT * FROM {SENTS} ORDER BY sentenceid DESC LIMIT 100) q LEFT JOIN (SELECT sourceid, max(title) AS title FROM sources GROUP BY 1) x ON x.sourceid=q.sourceid")
def jn05(spark, sf):
    """Page first, join after."""
    page = sents(spark, sf).orderBy(F.desc("sentenceid")).limit(100)
    return page.join(table(spark, sf, "sources").groupBy("sourceid").agg(F.max("title").alias("title")), "sourceid", "left").select("sentenceid", "title")


both("jn06", "SELECT s.sentenceid FROM {sentences} s LEFT ANTI JOIN {sources} o ON o.sourceid = s.sourceid", "sentences", "sources", duck="SELECT s.sentenceid FROM sentences s LEFT JOIN (SELECT DISTINCT sourceid FROM sources) o ON o.sourceid=s.sourceid WHERE o.sourceid IS NULL")
both("jn07", "SELECT o.sourceid FROM {sources} o WHERE NOT EXISTS (SELECT 1 FROM {contents} c WHERE c.sourceid = o.sourceid)", "sources", "contents")
both("jn08", "SELECT sentenceid FROM {sentences} WHERE sourceid IN (SELECT sourceid FROM {sources} WHERE groupname = 'makanimalie')", "sentences", "sources")
both("jn09", "SELECT c.sourceid, o.groupname FROM {contents} c, {sources} o WHERE c.sourceid = o.sourceid AND c.text IS NOT NULL AND c.text <> ''", "contents", "sources")
both("jn10", "SELECT DISTINCT c.sourceid FROM {contents} c JOIN {sources} o ON o.sourceid = c.sourceid WHERE NOT EXISTS (SELECT 1 FROM {sentences} s WHERE s.sourceid = c.sourceid)", "contents", "sources", "sentences")
both("jn11", "SELECT d.doc_id, coalesce(g.grade, 0) AS grade FROM {documents} d LEFT JOIN (SELECT doc_id, max(grade) AS grade FROM {reading_labels} GROUP BY doc_id) g ON g.doc_id = d.doc_id", "documents", "reading_labels")


@op("jn12", "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]),5) AS dot FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id=0) q")
def jn12(spark, sf):
    """Every row against the one query row."""
    e = table(spark, sf, "embeddings")
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(F.broadcast(V.query_vector(e))).select("vec_id", F.round(dot, 5).alias("dot"))


_ENT = r"(SELECT DISTINCT doc_id, unnest(regexp_extract_all(title,'[A-ZĀĒĪŌŪ][a-zāēīōūʻ]+')) AS name FROM documents WHERE title IS NOT NULL)"


@op("jn13", f"SELECT a.name AS a, b.name AS b, count(*) AS weight FROM {_ENT} a JOIN {_ENT} b ON a.doc_id=b.doc_id AND a.name<b.name GROUP BY 1,2")
def jn13(spark, sf):
    """Co-mentions: the pairs of a document's few names by array functions, counted; no self-join of rows."""
    from kilohana.operators.graph import co_mentions

    names = F.array_sort(F.array_distinct(F.regexp_extract_all("title", F.lit("([A-ZĀĒĪŌŪ][a-zāēīōūʻ]+)"))))
    return co_mentions(table(spark, sf, "documents").where("title IS NOT NULL").select(names.alias("names")))


@op("jn14", f"SELECT s.sentenceid, n.name FROM {SENTS} JOIN (SELECT unnest(['Hilo','Kiwala','Iniha','Leali','Emaʻō']) AS name) n ON contains(lower(s.hawaiiantext), lower(n.name))")
def jn14(spark, sf):
    """Names contained in sentences: the list of names is a literal, so the test is one expression over each row."""
    from kilohana.operators.graph import contained_names

    return contained_names(sents(spark, sf), ["Hilo", "Kiwala", "Iniha", "Leali", "Emaʻō"])


@op("jn15", f"SELECT sentenceid, name FROM (SELECT s.sentenceid, n.name, row_number() OVER (PARTITION BY s.sentenceid ORDER BY n.k) AS rn FROM {SENTS} JOIN (SELECT unnest(['Kiwala','Iniha','Leali']) AS name, unnest([0,1,2]) AS k) n ON contains(lower(s.hawaiiantext), lower(n.name))) t WHERE rn=1")
def jn15(spark, sf):
    """Containment, the first name of the list wins."""
    names = ["Kiwala", "Iniha", "Leali"]
    first = F.coalesce(*[F.when(F.lower("hawaiiantext").contains(n.lower()), n) for n in names])
    return sents(spark, sf).select("sentenceid", first.alias("name")).where("name IS NOT NULL")


@op("jn16", r"WITH t AS (SELECT DISTINCT unnest(string_split_regex(lower(searchterm),'\s+')) AS w FROM searchstats WHERE searchterm IS NOT NULL), d AS (SELECT DISTINCT unnest(string_split_regex(lower(title),'\s+')) AS w FROM sources WHERE title IS NOT NULL) SELECT t.w, d.w IS NOT NULL AS known FROM t LEFT JOIN d ON d.w=t.w")
def jn16(spark, sf):
    """Words looked up in a list."""
    t = table(spark, sf, "searchstats").where("searchterm IS NOT NULL").select(F.explode(F.split(F.lower("searchterm"), r"\s+")).alias("w")).distinct()
    d = table(spark, sf, "sources").where("title IS NOT NULL").select(F.explode(F.split(F.lower("title"), r"\s+")).alias("w")).distinct().withColumn("k", F.lit(True))
    return t.join(d, "w", "left").select("w", F.coalesce("k", F.lit(False)).alias("known"))


_K17 = "trim(lower(translate({c},'ōīēūāŌĪĒŪĀ‘ʻ\'\'','oieuaOIEUA')))"
_L17 = {
    "ssa": "SELECT unnest(string_split(authors,' ')) AS w FROM sources",
    "ssa-hawaii": "SELECT unnest(regexp_extract_all(passage,'[A-ZĀĒĪŌŪʻ][\\p{L}ʻ]+')) FROM eval_items",
    "given": "SELECT regexp_extract(sourcename,'^([^: ]+)',1) FROM sources",
    "place": "SELECT groupname FROM sources",
    "hawaiian-word": "SELECT unnest(string_split(title,' ')) FROM sources",
    "english-word": "SELECT unnest(regexp_extract_all(prompt,'[A-Za-z]+')) FROM eval_items",
}
_J17 = " ".join(f"LEFT JOIN (SELECT DISTINCT {_K17.format(c='w')} AS k FROM ({q}) t(w) WHERE w IS NOT NULL) l{i} ON l{i}.k=e.k" for i, q in enumerate(_L17.values()))
_C17 = " ".join(f"WHEN l{i}.k IS NOT NULL THEN '{n}'" for i, n in enumerate(_L17))


@op("jn17", f"WITH e AS (SELECT DISTINCT {_K17.format(c='w')} AS k FROM (SELECT unnest(string_split(searchterm,' ')) AS w FROM searchstats WHERE searchterm IS NOT NULL) t) SELECT e.k AS name, CASE {_C17} ELSE 'skip' END AS kind FROM e {_J17} WHERE e.k<>''")
def jn17(spark, sf):
    """Words classified by the first of six lists that holds them, each list from a table of its own."""
    from kilohana.functions.text import normalize_word_marks as key

    src, ev = table(spark, sf, "sources"), table(spark, sf, "eval_items")
    lists = {
        "ssa": src.select(F.explode(F.split("authors", " ")).alias("w")),
        "ssa-hawaii": ev.select(F.explode(F.regexp_extract_all("passage", F.lit(r"[A-ZĀĒĪŌŪʻ][\p{L}ʻ]+"), F.lit(0))).alias("w")),
        "given": src.select(F.regexp_extract("sourcename", "^([^: ]+)", 1).alias("w")),
        "place": src.select(F.col("groupname").alias("w")),
        "hawaiian-word": src.select(F.explode(F.split("title", " ")).alias("w")),
        "english-word": ev.select(F.explode(F.regexp_extract_all("prompt", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")),
    }
    e = table(spark, sf, "searchstats").where("searchterm IS NOT NULL").select(F.explode(F.split("searchterm", " ")).alias("w")).select(key(F.col("w")).alias("k")).where("k <> ''").distinct()
    kind = F.lit("skip")
    for n, d in reversed(lists.items()):
        e = e.join(d.where("w IS NOT NULL").select(key(F.col("w")).alias("k"), F.lit(1).alias(f"in {n}")).distinct(), "k", "left")
        kind = F.when(F.col(f"in {n}").isNotNull(), n).otherwise(kind)
    return e.select(F.col("k").alias("name"), kind.alias("kind"))


@op("jn18", "WITH e AS (SELECT DISTINCT authors AS name, lower(authors) AS k FROM sources WHERE authors IS NOT NULL), o AS (SELECT lower(searchterm) AS k, max(pattern) AS action FROM searchstats WHERE searchterm IS NOT NULL GROUP BY 1) SELECT e.name, o.action FROM e LEFT JOIN o ON o.k=e.k")
def jn18(spark, sf):
    """Entities with their override by normalised name."""
    e = table(spark, sf, "sources").where("authors IS NOT NULL").select(F.col("authors").alias("name")).distinct().withColumn("k", F.lower("name"))
    o = table(spark, sf, "searchstats").where("searchterm IS NOT NULL").groupBy(F.lower("searchterm").alias("k")).agg(F.max("pattern").alias("action"))
    return e.join(o, "k", "left").select("name", "action")


both("jn19", "SELECT 'sources only' AS side, sourceid FROM (SELECT DISTINCT sourceid FROM {sources}) a WHERE NOT EXISTS (SELECT 1 FROM {sentences} s WHERE s.sourceid = a.sourceid) UNION ALL SELECT 'sentences only', sourceid FROM (SELECT DISTINCT sourceid FROM {sentences}) b WHERE NOT EXISTS (SELECT 1 FROM {sources} o WHERE o.sourceid = b.sourceid)", "sources", "sentences")
both("jn20", "SELECT DISTINCT o.sourceid FROM {sources} o LEFT JOIN {contents} c ON c.sourceid = o.sourceid WHERE c.text IS NULL", "sources", "contents", doc="Without a page, or with a page without text: more than an anti-join.")
both("jn21", "SELECT o.sourceid, count(*) AS n FROM {sources} o JOIN {sentences} s ON s.sourceid = o.sourceid WHERE o.sourceid >= 1100 AND o.sourceid < 1300 GROUP BY o.sourceid", "sources", "sentences")

both("so01", "SELECT 'sources' AS t, count(*) AS n FROM {sources} UNION ALL SELECT 'contents', count(*) FROM {contents} UNION ALL SELECT 'sentences', count(*) FROM {sentences}", "sources", "contents", "sentences")
both("so02", "SELECT DISTINCT sourceid FROM {sentences} EXCEPT SELECT sourceid FROM {sources}", "sentences", "sources")
both("so03", "SELECT s.sentenceid, s.sourceid FROM {sentences} s WHERE EXISTS (SELECT 1 FROM {sources} o WHERE o.sourceid = s.sourceid)", "sentences", "sources", doc="What is left when orphans are deleted.")


@op("so04", "(SELECT 'missing' AS side, sourceid FROM (SELECT sourceid FROM sources EXCEPT SELECT sourceid FROM contents) a) UNION ALL (SELECT 'extra', sourceid FROM (SELECT sourceid FROM contents EXCEPT SELECT sourceid FROM sources) b)")
def so04(spark, sf):
    """Differences of two stores' ids, both ways."""
    from kilohana.operators.maintain import sync_diff

    return sync_diff(table(spark, sf, "sources"), table(spark, sf, "contents"), "sourceid")


@op("so05", r"SELECT doc_id, list_sort(list_distinct(string_split_regex(lower(title),'\s+'))) AS words FROM documents WHERE title IS NOT NULL")
def so05(spark, sf):
    return table(spark, sf, "documents").where("title IS NOT NULL").select("doc_id", F.array_sort(F.array_distinct(F.split(F.lower("title"), r"\s+"))).alias("words"))


both("so06", "SELECT sentenceid FROM {sentences} WHERE hawaiiantext LIKE 'Ua %' UNION SELECT sentenceid FROM {sentences} WHERE hawaiiantext LIKE '%mahina%'", "sentences")


@op("so07", r"SELECT sentenceid, list_sort(list_intersect(list_distinct(string_split_regex(lower(hawaiiantext),'\s+')),['ka','hale','ua'])) AS w FROM sentences")
def so07(spark, sf):
    w = F.array_sort(F.array_intersect(F.split(F.lower("hawaiiantext"), r"\s+"), F.array(F.lit("ka"), F.lit("hale"), F.lit("ua"))))
    return table(spark, sf, "sentences").select("sentenceid", w.alias("w"))


#: Orders by name; text breaks ties, then the id.
ORDERS = {
    "alpha": [("hawaiiantext", True)],
    "alpha desc": [("hawaiiantext", False)],
    "length": [("octet_length(hawaiiantext)", True), ("hawaiiantext", True)],
    "length desc": [("octet_length(hawaiiantext)", False), ("hawaiiantext", True)],
    "source": [("sourceid", True), ("hawaiiantext", True)],
    "none": [("sentenceid", True)],
}


def order_by(df, name: str, key: str = "sentenceid"):
    """Order by a name of the list; unknown names order by the key."""
    cols = [F.expr(c).asc() if up else F.expr(c).desc() for c, up in ORDERS.get(name, ORDERS["none"])]
    return df.orderBy(*cols, key)


@op("st01", f"SELECT sentenceid, hawaiiantext FROM {SENTS} ORDER BY strlen(hawaiiantext) DESC, hawaiiantext COLLATE \"C\", sentenceid LIMIT 50".replace(' COLLATE "C"', ""))
def st01(spark, sf):
    return order_by(sents(spark, sf), "length desc").limit(50).select("sentenceid", "hawaiiantext")


@op("st02", f"SELECT p.sentenceid, p.pattern_type, x.date FROM {PATTERNS} p JOIN (SELECT sourceid, max(date) AS date FROM sources GROUP BY 1) x ON x.sourceid=p.sourceid WHERE x.date IS NOT NULL AND p.pattern_type='pepeke_henua' ORDER BY x.date, p.sentenceid LIMIT 50")
def st02(spark, sf):
    """Grammar matches by date, undated ones left out."""
    x = table(spark, sf, "sources").groupBy("sourceid").agg(F.max("date").alias("date")).where("date IS NOT NULL")
    return patterns(spark, sf).where("pattern_type = 'pepeke_henua'").join(x, "sourceid").orderBy("date", "sentenceid").limit(50).select("sentenceid", "pattern_type", "date")


@op("st03")
def st03(spark, sf):
    """A random order that a seed fixes."""
    return sents(spark, sf).orderBy(F.xxhash64("sentenceid", F.lit(7)), "sentenceid").limit(20).select("sentenceid")


both("st04", "SELECT DISTINCT sentenceid FROM {sentences} ORDER BY sentenceid LIMIT 20 OFFSET 40", "sentences")
both("st05", "SELECT DISTINCT sentenceid FROM {sentences} ORDER BY sentenceid DESC LIMIT 20 OFFSET 20", "sentences")
both("st06", "SELECT DISTINCT sentenceid FROM {sentences} WHERE sentenceid > 3000 ORDER BY sentenceid LIMIT 25", "sentences")


@op("st07", "SELECT doc_id, source, n_chars FROM documents ORDER BY source ASC NULLS FIRST, n_chars DESC NULLS LAST, doc_id LIMIT 60")
def st07(spark, sf):
    """Sort by several fields of a white list."""
    allowed = {"source", "n_chars", "doc_id", "title"}
    spec = [("source", "asc"), ("n_chars", "desc")]
    cols = [F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in spec if c in allowed]
    return table(spark, sf, "documents").orderBy(*cols, "doc_id").limit(60).select("doc_id", "source", "n_chars")


@op("st08", "SELECT sourceid, authors, title FROM (SELECT DISTINCT sourceid, authors, title FROM sources) t ORDER BY (coalesce(authors,'')=''), lower(coalesce(authors,'')), sourceid, title NULLS FIRST LIMIT 80")
def st08(spark, sf):
    """Case aside, empties last."""
    a = F.coalesce("authors", F.lit(""))
    return table(spark, sf, "sources").select("sourceid", "authors", "title").distinct().orderBy(a == "", F.lower(a), "sourceid", "title").limit(80)


@op("st09", f"SELECT sentenceid, pattern_type FROM {PATTERNS} p WHERE pattern_type='pepeke_henua' ORDER BY sentenceid LIMIT 10 OFFSET 10")
def st09(spark, sf):
    return patterns(spark, sf).where("pattern_type = 'pepeke_henua'").orderBy("sentenceid").offset(10).limit(10).select("sentenceid", "pattern_type")


both("st10", "SELECT sourceid, count(*) AS n FROM {sentences} GROUP BY sourceid ORDER BY n DESC, sourceid LIMIT 20", "sentences")
both("st11", "SELECT DISTINCT sourceid FROM {sources} ORDER BY sourceid", "sources")


@op("st12")
def st12(spark, sf):
    """The longest word of a sentence picked by a seed."""
    s = sents(spark, sf).orderBy(F.xxhash64("sentenceid", F.lit(11)), "sentenceid").limit(1)
    w = s.select("sentenceid", F.explode(T.words_unicode(F.col("hawaiiantext"))).alias("w"))
    return w.groupBy("sentenceid").agg(F.max_by("w", F.struct(F.length("w"), F.col("w"))).alias("word"))


both("st13", "SELECT doc_id FROM {documents} ORDER BY doc_id LIMIT 100", "documents")

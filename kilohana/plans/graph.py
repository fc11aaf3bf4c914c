"""Graph operators (GR) over the entities of documents' texts: every document, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilohana.operators import graph as G
from kilohana.registry import op
from kilohana.session import cut_lineage, table

# The twin: runs of capitalised words are marked, their places counted from the parts before them, and typed by name and surroundings.
_FIRST = ",".join(f"'{x}'" for x in G.FIRST_NAMES)
_COMMON = ",".join(f"'{x}'" for x in G.COMMON)
_PLACE = "|".join(G.PLACE_WORDS)


def norm_sql(c: str) -> str:
    return rf"regexp_replace(translate(lower(trim({c})),'ʻ''',''),'\s+',' ','g')"


_ENTS = rf"""
d AS (SELECT doc_id, text, string_split(regexp_replace(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b', chr(1) || '\0' || chr(2), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, text, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS i FROM d),
w AS (SELECT doc_id, text, i, split_part(part, chr(2), 1) AS name, sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i) - length(replace(part, chr(2), '')) AS ofs FROM q),
r AS (SELECT doc_id, i AS pos, name, CASE WHEN name IN ({_FIRST}) THEN 'Person'
  WHEN regexp_matches(substr(text, greatest(ofs - 20, 0)::BIGINT + 1, (ofs - greatest(ofs - 20, 0) + length(name) + 20)::BIGINT), '(?i){_PLACE}') THEN 'Location' ELSE 'Entity' END AS kind
  FROM w WHERE i > 1 AND lower(name) NOT IN ({_COMMON})),
t AS (SELECT doc_id, unnest(range(1, len(x) + 1)) + 10000000 AS pos, unnest(x) AS name, 'Date' AS kind FROM (SELECT doc_id, regexp_extract_all(text, '\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}})\b') AS x FROM d) z),
m AS (SELECT doc_id, min(pos) AS pos, name, kind, upper(kind) || '_' || substr(sha1(upper(kind) || '|' || {norm_sql('name')}), 1, 24) AS id, {norm_sql('name')} AS norm
  FROM (SELECT * FROM r UNION ALL SELECT * FROM t) u GROUP BY doc_id, name, kind)"""
_PAIRS = rf""",
s AS (SELECT doc_id, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, string_split_regex(text, '[.!?;\n]+') AS x FROM d) y),
h AS (SELECT s.doc_id, s.k, m.id, min(m.pos) AS pos FROM s JOIN m ON m.doc_id = s.doc_id AND contains(lower(s.s), lower(m.name)) GROUP BY 1, 2, 3),
c AS (SELECT a.doc_id, a.id AS x, b.id AS y, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.k, a.pos, b.pos) AS rn FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.k = b.k AND a.pos < b.pos),
co AS (SELECT DISTINCT doc_id, least(x, y) AS source, greatest(x, y) AS target FROM c WHERE rn <= {G.MOST_PAIRS}),
e AS (SELECT source AS src, 'CO_OCCURS_WITH' AS rel, target AS dst, count(*) AS weight FROM co GROUP BY 1, 2, 3)"""
_B = r"(?:^|[^\p{L}\p{N}_])"


def _verbs_sql() -> str:
    one = []
    for rel, verb in G.VERBS:
        rx = ("(?i)" + _B + G.PHRASE + verb + G.PHRASE).replace("'", "''")
        one.append(f"SELECT doc_id, '{rel}' AS relation, unnest(regexp_extract_all(text, '{rx}', 1)) AS a, unnest(regexp_extract_all(text, '{rx}', 2)) AS b FROM d")
    return " UNION ALL ".join(one)


def _first_sql(name: str) -> str:
    n = norm_sql("v." + name)
    return f"(SELECT arg_min(m.id, m.pos) FROM m WHERE m.doc_id = v.doc_id AND {n} <> '' AND m.norm <> '' AND (contains(m.norm, {n}) OR contains({n}, m.norm)))"


def extracted(spark, sf):
    return G.extract(table(spark, sf, "documents"), "text", "doc_id")


def mentions(spark, sf):
    """(doc_id, pos, name, kind, id)."""
    return G.entities(table(spark, sf, "documents"), "text", "doc_id")


def pairs(spark, sf):
    """(doc_id, source, target): co-occurrence in a sentence."""
    x = extracted(spark, sf).select("doc_id", F.explode(G.co_occurrence_array(F.col("text"), F.col("ents"))).alias("p"))
    return x.select("doc_id", "p.source", "p.target")


def edges(spark, sf):
    """(src, rel, dst, weight): the documents' pairs counted."""
    return pairs(spark, sf).groupBy(F.col("source").alias("src"), F.lit("CO_OCCURS_WITH").alias("rel"), F.col("target").alias("dst")).agg(F.count("*").alias("weight"))


@op("gr01", f"WITH {_ENTS} SELECT doc_id, name, kind, id FROM m")
def gr01(spark, sf):
    """Entities of texts with kind and id."""
    return mentions(spark, sf).select("doc_id", "name", "kind", "id")


_MALE = ",".join(f"'{x}'" for x in G.FIRST_NAMES[:31] + G.FEMALE_NAMES)


@op("gr02", rf"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, name, CASE WHEN name IN ({_MALE}) THEN 'Person' ELSE 'Location' END AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)*\b')) AS name FROM d) a WHERE lower(name) NOT IN ({",".join(f"'{x}'" for x in G.COMMON[:-1])})
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b')), 'Date' FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{{4}}\b')), 'Year' FROM d)
SELECT DISTINCT doc_id, name, kind, kind || '_' || upper(regexp_replace(name, '[^a-zA-Z0-9]', '_', 'g')) AS id FROM u""")
def gr02(spark, sf):
    """The plain extractor; its random id suffix is left out, so a name has one id."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.explode(G.basic_entity_array(F.col("text"))).alias("e")).select("doc_id", "e.name", "e.kind", "e.id")


@op("gr03", f"WITH {_ENTS}, v AS ({_verbs_sql()}), z AS (SELECT v.doc_id, {_first_sql('a')} AS source, v.relation, {_first_sql('b')} AS target FROM v) SELECT DISTINCT doc_id, source, relation, target FROM z WHERE source <> target")
def gr03(spark, sf):
    """Relations that verbs say between names, resolved to the text's entities."""
    x = extracted(spark, sf).select("doc_id", F.explode(G.relation_array(F.col("text"), F.col("ents"))).alias("r"))
    return x.select("doc_id", "r.source", "r.relation", "r.target")


@op("gr04", f"WITH {_ENTS}{_PAIRS} SELECT doc_id, source, target FROM co WHERE source <> target")
def gr04(spark, sf):
    return pairs(spark, sf)


_WORDS = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
_RX5 = ["(?i)" + _WORDS + r"\s+(?:founded|started|established|visited|created|built|lived|studied|attended)\s+([A-Z][a-z]+)", "(?i)" + _WORDS + r"\s+(?:is|was)\s+(?:located|situated|found)\s+in\s+([A-Z][a-z]+)"]
_KIND5 = "CASE " + " ".join(f"WHEN contains(lower(h),'{w}') THEN '{k}'" for w, k in G.BASIC_KINDS) + " ELSE 'RELATED' END"
_HELD5 = "(SELECT arg_max(kind || '_' || upper(b.name), b.pos) FROM b WHERE b.doc_id = r.doc_id AND contains(lower(b.name), lower(r.{c})))"


@op("gr05", rf"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(x) AS name, unnest(range(len(x))) AS pos, 0 AS g FROM (SELECT doc_id, regexp_extract_all(text, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)*\b') AS x FROM d) a),
b AS (SELECT doc_id, name, min(pos) AS pos, CASE WHEN name IN ({_MALE}) THEN 'Person' ELSE 'Location' END AS kind FROM u WHERE lower(name) NOT IN ({",".join(f"'{x}'" for x in G.COMMON[:-1])}) GROUP BY 1, 2),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_RX5[0]}', 1)) AS a, unnest(regexp_extract_all(text, '{_RX5[0]}', 2)) AS z, unnest(regexp_extract_all(text, '{_RX5[0]}')) AS h, false AS l FROM d
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '{_RX5[1]}', 1)), unnest(regexp_extract_all(text, '{_RX5[1]}', 2)), unnest(regexp_extract_all(text, '{_RX5[1]}')), true FROM d)
SELECT doc_id, {_HELD5.format(c='a')} AS source, CASE WHEN l THEN 'LOCATED_IN' ELSE {_KIND5} END AS relation, {_HELD5.format(c='z')} AS target FROM r WHERE {_HELD5.format(c='a')} IS NOT NULL AND {_HELD5.format(c='z')} IS NOT NULL""")
def gr05(spark, sf):
    """The plain relations (founded, visited, ..., located in)."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    x = d.select("doc_id", F.explode(G.basic_relation_array(F.col("text"), G.basic_entity_array(F.col("text")))).alias("r"))
    return x.select("doc_id", "r.source", "r.relation", "r.target")


@op("gr06", f"WITH {_ENTS}{_PAIRS} SELECT (SELECT count(DISTINCT id) FROM m) AS entities, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM e) AS relations")
def gr06(spark, sf):
    one = mentions(spark, sf).agg(F.countDistinct("id").alias("entities"))
    return one.crossJoin(F.broadcast(table(spark, sf, "documents").agg(F.count("*").alias("documents")))).crossJoin(F.broadcast(edges(spark, sf).agg(F.count("*").alias("relations"))))


@op("gr07", f"WITH {_ENTS}{_PAIRS} SELECT kind AS label, count(DISTINCT id) AS n FROM m GROUP BY 1 UNION ALL SELECT rel, count(*) FROM e GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def gr07(spark, sf):
    """Labels and relation types with their numbers."""
    n = mentions(spark, sf).groupBy(F.col("kind").alias("label")).agg(F.countDistinct("id").alias("n"))
    return n.unionByName(edges(spark, sf).groupBy(F.col("rel").alias("label")).agg(F.count("*").alias("n"))).orderBy(F.desc("n"), "label").limit(20)


@op("gr08", f"WITH {_ENTS}{_PAIRS}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) t GROUP BY 1 ORDER BY degree DESC, id LIMIT 20) SELECT g.id, g.degree, (SELECT count(*) FROM m WHERE m.id = g.id) AS mentions FROM g")
def gr08(spark, sf):
    """The nodes of most edges, with their mentions."""
    # One pass over the texts gives both: mentions as rows without a second end. Counted once, the rows are read twice from one exchange.
    none = F.lit(None).cast("string")
    ends = G.bound(F.col("ents"), lambda e: F.concat(F.transform(e, lambda x: F.struct(x["id"].alias("source"), none.alias("target"))), G.co_occurrence_array(F.col("text"), e)))
    rows = extracted(spark, sf).select(F.explode(ends).alias("r")).select("r.source", "r.target").groupBy("source", "target").agg(F.count("*").alias("n"))
    pairs_ = rows.where("target IS NOT NULL").select(F.explode(F.array("source", "target")).alias("id"))
    top = pairs_.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(20)
    n = rows.where("target IS NULL").select(F.col("source").alias("id"), F.col("n").alias("mentions"))
    return top.join(n, "id", "left").select("id", "degree", F.coalesce("mentions", F.lit(0)).alias("mentions"))


@op("gr09", f"WITH {_ENTS}{_PAIRS} SELECT DISTINCT id FROM m WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)")
def gr09(spark, sf):
    return G.isolated(mentions(spark, sf).select("id").distinct(), edges(spark, sf))


@op("gr10", f"WITH {_ENTS} SELECT x.doc_id, x.title, count(m.id) AS n FROM (SELECT doc_id, title FROM documents ORDER BY added DESC NULLS LAST, doc_id DESC LIMIT 25) x LEFT JOIN m ON m.doc_id = x.doc_id GROUP BY 1, 2")
def gr10(spark, sf):
    """Documents added last, with title and mentions."""
    top = table(spark, sf, "documents").select("doc_id", "title", "added", F.when(F.col("text").isNotNull(), F.size(G.entity_array(F.col("text")))).otherwise(0).cast("long").alias("n"))
    return top.orderBy(F.desc_nulls_last("added"), F.desc("doc_id")).limit(25).select("doc_id", "title", "n")


@op("gr11", f"WITH {_ENTS}{_PAIRS}, x AS (SELECT DISTINCT id, name FROM m WHERE contains(lower(name), 'kanake')) SELECT x.id, x.name, e.rel, CASE WHEN e.src = x.id THEN e.dst ELSE e.src END AS neighbour FROM x LEFT JOIN e ON e.src = x.id OR e.dst = x.id")
def gr11(spark, sf):
    """Entities whose name holds a string, with their neighbours."""
    x = mentions(spark, sf).where(F.lower("name").contains("kanake")).select("id", "name").distinct()
    e = edges(spark, sf)
    both = e.select(F.col("src").alias("id"), "rel", F.col("dst").alias("neighbour")).unionByName(e.where("src <> dst").select(F.col("dst").alias("id"), "rel", F.col("src").alias("neighbour")))
    return x.join(both, "id", "left").select("id", "name", "rel", "neighbour")


@op("gr12", f"WITH {_ENTS}{_PAIRS}, z AS (SELECT min(src) AS a FROM e), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src || '>' || dst AS path FROM b, z WHERE src = a UNION ALL SELECT x.src || '>' || x.dst || '>' || y.dst FROM z, b x JOIN b y ON x.dst = y.src WHERE x.src = a AND y.dst <> a")
def gr12(spark, sf):
    """Paths of one and two steps from the first node."""
    e = cut_lineage(edges(spark, sf))
    first = e.agg(F.min("src").alias("a")).first()["a"]
    return G.two_hops(e, first or "")


@op("gr13", f"WITH {_ENTS}, g AS (SELECT name, kind, count(*) AS n FROM m WHERE contains(lower(name), 'ka') GROUP BY 1, 2) SELECT name, kind, n, (SELECT count(*) FROM g) AS total, (SELECT count(*) FROM g) > 40 AS has_more FROM g ORDER BY n DESC, name, kind LIMIT 20 OFFSET 20")
def gr13(spark, sf):
    """A page of the entities that a search finds, with their number and whether more follow."""
    g = mentions(spark, sf).where(F.lower("name").contains("ka")).groupBy("name", "kind").agg(F.count("*").alias("n"))
    total = F.broadcast(g.agg(F.count("*").alias("total")))
    return g.orderBy(F.desc("n"), "name", "kind").offset(20).limit(20).crossJoin(total).withColumn("has_more", F.col("total") > 40)


@op("gr14", f"WITH {_ENTS}{_PAIRS} SELECT 'nodes' AS t, count(DISTINCT id) AS n FROM m UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'hits', 0")
def gr14(spark, sf):
    """Numbers of the graph; its own search finds nothing, as the store gives none."""
    n = mentions(spark, sf).agg(F.lit("nodes").alias("t"), F.countDistinct("id").alias("n"))
    return n.unionByName(edges(spark, sf).agg(F.lit("edges").alias("t"), F.count("*").alias("n"))).unionByName(spark.createDataFrame([("hits", 0)], "t string, n long"))


@op("gr15", f"WITH {_ENTS} SELECT kind, count(*) AS n FROM m WHERE doc_id IN (SELECT doc_id FROM documents WHERE strlen(text) >= 20) AND doc_id NOT IN (SELECT doc_id FROM reading_labels WHERE doc_id IS NOT NULL) GROUP BY 1")
def gr15(spark, sf):
    """A backfill: texts of 20 bytes and more whose ids are not in the table of those done, here the labelled documents."""
    done = table(spark, sf, "reading_labels").select("doc_id").distinct()
    d = table(spark, sf, "documents").where(F.octet_length("text") >= 20).join(done, "doc_id", "left_anti")
    return G.entities(d, "text", "doc_id").groupBy("kind").agg(F.count("*").alias("n"))


_NW = r"trim(lower(translate({c},'ōīēūāŌĪĒŪĀ‘ʻ''','oieuaOIEUA')))"


@op("gr16", rf"""WITH {_ENTS}, n AS (SELECT DISTINCT name, kind, {_NW.format(c='name')} AS k FROM m),
o AS (SELECT DISTINCT {_NW.format(c='searchterm')} AS k FROM searchstats WHERE searchterm IS NOT NULL),
a AS (SELECT DISTINCT {_NW.format(c='x')} AS k FROM (SELECT unnest(string_split(authors, ' ')) AS x FROM sources) z WHERE x <> ''),
g AS (SELECT DISTINCT {_NW.format(c='groupname')} AS k FROM sources WHERE groupname IS NOT NULL),
f AS (SELECT lang, {_NW.format(c='w')} AS k, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[\p{{L}}ʻ‘'']+')) AS w FROM documents WHERE lang IN ('haw', 'en')) y GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 5)
SELECT n.name, n.kind, CASE WHEN n.k = '' OR o.k IS NOT NULL OR n.kind IN ('Person', 'Place') THEN 'skip' WHEN a.k IS NOT NULL THEN 'include:person-name' WHEN g.k IS NOT NULL THEN 'include:place'
WHEN h.k IS NOT NULL THEN 'stopword:hawaiian-word' WHEN x.k IS NOT NULL THEN 'stopword:english-word' ELSE 'skip' END AS action
FROM n LEFT JOIN o ON o.k = n.k LEFT JOIN a ON a.k = n.k LEFT JOIN g ON g.k = n.k LEFT JOIN (SELECT k FROM f WHERE lang = 'haw') h ON h.k = n.k LEFT JOIN (SELECT k FROM f WHERE lang = 'en') x ON x.k = n.k""")
def gr16(spark, sf):
    """Entities classified in order: override there, label trusted, name list, place list, Hawaiian word, English word; else skipped.

    The lists: search terms as overrides, authors' names, groups as places, words of at least five documents of a language.
    """
    from kilohana.functions.text import normalize_word_marks as key

    src, docs = table(spark, sf, "sources"), table(spark, sf, "documents")
    n = mentions(spark, sf).select("name", "kind").distinct().withColumn("k", key(F.col("name")))
    over = table(spark, sf, "searchstats").where("searchterm IS NOT NULL").select(key(F.col("searchterm")).alias("k"))
    people = src.select(F.explode(F.split("authors", " ")).alias("x")).where("x <> ''").select(key(F.col("x")).alias("k"))
    places = src.where("groupname IS NOT NULL").select(key(F.col("groupname")).alias("k"))
    w = docs.where("lang IN ('haw', 'en') AND text IS NOT NULL").select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}ʻ‘']+"), F.lit(0)))).alias("w"))
    w = w.select("doc_id", "lang", key(F.col("w")).alias("k")).distinct().groupBy("lang", "k").agg(F.count("*").alias("n")).where("n >= 5")
    for name, d in (("o", over), ("a", people), ("g", places), ("h", w.where("lang = 'haw'").select("k")), ("x", w.where("lang = 'en'").select("k"))):
        n = n.join(d.distinct().withColumn(name, F.lit(1)), "k", "left")
    action = F.when((F.col("k") == "") | F.col("o").isNotNull() | F.col("kind").isin("Person", "Place"), "skip").when(F.col("a").isNotNull(), "include:person-name").when(F.col("g").isNotNull(), "include:place")
    action = action.when(F.col("h").isNotNull(), "stopword:hawaiian-word").when(F.col("x").isNotNull(), "stopword:english-word").otherwise("skip")
    return n.select("name", "kind", action.alias("action"))


@op("sk17", f"WITH {_ENTS} SELECT id, kind AS label, min(name) AS name, count(*) AS n FROM m GROUP BY 1, 2")
def sk17(spark, sf):
    """Nodes merged by label and id."""
    return mentions(spark, sf).groupBy("id", F.col("kind").alias("label")).agg(F.min("name").alias("name"), F.count("*").alias("n"))


@op("sk18", f"WITH {_ENTS}{_PAIRS} SELECT src, 'CO_MENTIONED_WITH' AS rel, dst, weight FROM e WHERE src IN (SELECT id FROM m WHERE kind <> 'Date') AND dst IN (SELECT id FROM m WHERE kind <> 'Date')")
def sk18(spark, sf):
    """Edges merged, weight 1 when made and one more each time; both ends must be nodes, here those that are no dates."""
    n = mentions(spark, sf).where("kind <> 'Date'").select("id").distinct()
    e = edges(spark, sf)
    e = e.join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select("src", F.lit("CO_MENTIONED_WITH").alias("rel"), "dst", "weight")


@op("sk19", f"WITH {_ENTS}, f AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, kind) AS rn FROM m) SELECT d.doc_id, coalesce(d.title, '') AS title, CAST(d.added AS TIMESTAMP) AS last_seen, f.id FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND f.rn <= 25")
def sk19(spark, sf):
    """Document nodes (an empty title stays empty, last seen when added) linked to their first 25 entities."""
    d = table(spark, sf, "documents")
    first = F.when(F.col("text").isNotNull(), F.slice(G.entity_array(F.col("text")), 1, 25))
    return d.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.col("added").alias("last_seen"), F.explode_outer(first).alias("e")).select("doc_id", "title", "last_seen", "e.id")

"""Retrieval modes (RT)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kilohana.functions import text as T
from kilohana.operators import search as S
from kilohana.operators import vector as V
from kilohana.plans.text import fold_sql
from kilohana.registry import op
from kilohana.session import table

H = "hawaiiantext"


def toks(c: str = H, folded: bool = False) -> str:
    return rf"list_filter(string_split_regex(lower({fold_sql(c) if folded else c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def sents(spark, sf):
    """One row per sentence id, with its text."""
    return table(spark, sf, "sentences").select("sentenceid", "sourceid", H).distinct()


SENTS = "(SELECT DISTINCT sentenceid, sourceid, hawaiiantext FROM sentences) s"
DOCS = "documents"


def mode(name: str, mode: str, term: str, sql: str, folded: bool = False, dialect: str = "elastic") -> None:
    def run(spark, sf):
        return S.search(sents(spark, sf), mode, term, folded=folded, dialect=dialect).select("sentenceid", H)

    run.__name__ = name
    run.__doc__ = f"{dialect} {mode}"
    op(name, f"SELECT sentenceid, hawaiiantext FROM {SENTS} WHERE {sql}")(run)


mode("rt01", "exact", "Ka Hale", "contains(lower(hawaiiantext),'ka hale')", dialect="mysql")
mode("rt02", "any", "hoku mahina", f"list_has_any({toks()},['hoku','mahina'])", dialect="mysql")


@op("rt03", f"SELECT s.sentenceid, s.hawaiiantext, x.sourcename FROM {SENTS} JOIN (SELECT sourceid, max(sourcename) AS sourcename FROM sources GROUP BY 1) x ON x.sourceid=s.sourceid WHERE list_has_all({toks()},['ka','hale','ua']) ORDER BY s.sentenceid LIMIT 500")
def rt03(spark, sf):
    """All words, with the source of each sentence, one page."""
    hits = S.search(sents(spark, sf), "all", "ka hale, ua", dialect="mysql").orderBy("sentenceid")
    src = table(spark, sf, "sources").groupBy("sourceid").agg(F.max("sourcename").alias("sourcename"))
    return hits.join(src, "sourceid").orderBy("sentenceid").limit(500).select("sentenceid", H, "sourcename")


mode("rt04", "regex", "^ua .* nui", "regexp_matches(hawaiiantext,'(?i)^ua .* nui')", dialect="mysql")
mode("rt05", "any", "hoku, mahina", f"list_has_any({toks()},['hoku','mahina'])", dialect="postgres")
mode("rt06", "all", "ka mahina", f"list_has_all({toks()},['ka','mahina'])", dialect="postgres")
mode("rt07", "hybrid", "ka hale", f"contains(' '||array_to_string({toks()},' ')||' ',' ka hale ')", dialect="postgres")
mode("rt08", "all", "nā pōhaku", f"list_has_all({toks(folded=True)},['na','pohaku'])", folded=True)
mode("rt11", "phrase", "no ka mea", f"contains(' '||array_to_string({toks()},' ')||' ',' no ka mea ')")
mode("rt12", "term", "hale", f"list_contains({toks()},'hale')")


@op("rt13", f"SELECT sentenceid, hawaiiantext FROM {SENTS} WHERE hawaiiantext='Ke kali nei mākou i kou manaʻo' UNION ALL SELECT sentenceid, hawaiiantext FROM {SENTS} WHERE list_contains({toks(folded=True)},'pohaku')")
def rt13(spark, sf):
    """A term over sentences: the whole text as it is, or a folded word."""
    s = sents(spark, sf)
    return s.where(F.col(H) == "Ke kali nei mākou i kou manaʻo").unionByName(S.search(s, "term", "pohaku", folded=True)).select("sentenceid", H)


@op("rt14", "SELECT doc_id FROM documents WHERE regexp_matches(title,'(?i)^(?:.*mahina.*)$') OR len(list_filter(string_split(text,chr(10)||chr(10)), lambda x: regexp_matches(x,'(?i)^(?:ua .* nui[.!?])$')))>0")
def rt14(spark, sf):
    """Anchored expression over the whole field or any chunk."""
    chunks = F.split("text", "\n\n")
    return table(spark, sf, "documents").where(F.col("title").rlike("(?i)^(?:.*mahina.*)$") | F.exists(chunks, lambda x: x.rlike("(?i)^(?:ua .* nui[.!?])$"))).select("doc_id")


mode("rt15", "regexp", "ua .* nui[.!?]", "regexp_matches(hawaiiantext,'(?i)^(?:ua .* nui[.!?])$')")
mode("rt16", "wildcard", "moe*papa", f"len(list_filter({toks()},lambda x: contains(x,'moe')))>0 AND len(list_filter({toks()},lambda x: contains(x,'papa')))>0")


@op("rt17", "SELECT doc_id, title FROM documents WHERE title ILIKE 'ka h_le%'")
def rt17(spark, sf):
    """* and ? over the whole value, case aside."""
    return table(spark, sf, "documents").where(F.col("title").ilike("ka h?le*".replace("*", "%").replace("?", "_"))).select("doc_id", "title")


def _bm25_sql(key: str, rows: str, text: str, words: list[str], all_words: bool, boost: str = "") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x='{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"sum(CASE WHEN tf{i}>0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(words)))
    score = "+".join(f"ln(1+(n-df{i}+0.5)/(df{i}+0.5))*tf{i}*2.2/(tf{i}+1.2*(0.25+0.75*len/a))" for i in range(len(words)))
    hit = (" AND " if all_words else " OR ").join(f"tf{i}>0" for i in range(len(words)))
    return f"WITH d AS (SELECT {key}, len(t) AS len, {tf} FROM (SELECT {key}, {toks(text)} AS t FROM {rows}) q), st AS (SELECT count(*) AS n, avg(len) AS a, {df} FROM d) SELECT {key}, round(({score}){boost},6) AS score FROM d, st WHERE {hit}"


@op("rt09", _bm25_sql("sentenceid", SENTS, H, ["hale", "mahina"], False))
def rt09(spark, sf):
    """Any word, BM25."""
    return S.bm25(sents(spark, sf), "sentenceid", "mahina hale")


@op("rt10", _bm25_sql("sentenceid", SENTS, H, ["hale", "ka"], True))
def rt10(spark, sf):
    """All words, BM25."""
    return S.bm25(sents(spark, sf), "sentenceid", "ka hale", all_words=True)


_RAT = f"(SELECT doc_id, text, CASE WHEN length(text)>0 THEN len(regexp_extract_all(text,'[āēīōūʻ]'))/length(text) END AS r FROM documents)"


@op("rt18", "SELECT b.doc_id, round(b.score*ln(1+coalesce(r.r,1)),6) AS score FROM (" + _bm25_sql("doc_id", DOCS, "text", ["hale", "mahina"], False).replace("round((", "(").replace("),6) AS score", ") AS score") + f") b JOIN {_RAT} r ON r.doc_id=b.doc_id")
def rt18(spark, sf):
    """Relevance times ln(1 + ratio of Hawaiian marks)."""
    d = table(spark, sf, "documents")
    ratio = F.when(F.length("text") > 0, F.regexp_count("text", F.lit("[āēīōūʻ]")) / F.length("text"))
    return S.bm25(d, "doc_id", "hale mahina", text="text", ratio=ratio)


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0)"
_COS = f"list_cosine_similarity(embedding::DOUBLE[],{_Q})"


@op("rt19", f"SELECT vec_id, round({_COS}+1,6) AS score FROM embeddings")
def rt19(spark, sf):
    """Brute force cosine plus one, over all rows."""
    e = table(spark, sf, "embeddings")
    return V.scored(e, V.query_vector(e)).select("vec_id", F.round(F.col("cos") + 1, 6).alias("score"))


@op("rt20", f"SELECT vec_id, round(({_COS}+1)*coalesce(label/10.0,0.0),6) AS score FROM embeddings WHERE embedding IS NOT NULL")
def rt20(spark, sf):
    """(cos+1) times a ratio, null-safe."""
    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    return V.scored(e, V.query_vector(e)).select("vec_id", F.round((F.col("cos") + 1) * F.coalesce(F.col("label") / 10.0, F.lit(0.0)), 6).alias("score"))


@op("rt21", f"SELECT vec_id, round((1+{_COS})/2,6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def rt21(spark, sf):
    e = table(spark, sf, "embeddings")
    return V.knn(e, V.query_vector(e), 20)


@op("rt22", f"SELECT vec_id, round((1+{_COS})/2,6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 5")
def rt22(spark, sf):
    """An alias of the nearest-neighbour search at sentence level."""
    e = table(spark, sf, "embeddings")
    return V.knn(e, V.query_vector(e), 5)


# Hybrid modes need a vector for each document: the one under its id modulo the number of vectors.
_VDOC = "(SELECT d.doc_id, d.text, e.vec_id, e.embedding FROM documents d JOIN embeddings e ON e.vec_id=d.doc_id%(SELECT max(vec_id)+1 FROM embeddings))"


def document_vectors(spark, sf, docs=None):
    """(doc_id, embedding) by an equi-join on the stored key; texts stay out of it."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.agg((F.max("vec_id") + 1).alias("_n"))  # one row
    d = (table(spark, sf, "documents") if docs is None else docs).select("doc_id").crossJoin(F.broadcast(n))
    return d.withColumn("vec_id", F.pmod("doc_id", "_n")).join(e, "vec_id").select("doc_id", "embedding")


_BV = _bm25_sql("doc_id", DOCS, "text", ["hale", "mahina"], False)


@op("rt23", f"WITH v AS (SELECT doc_id, list_cosine_similarity(embedding::DOUBLE[],{_Q})+1 AS c FROM {_VDOC} q), b AS ({_BV}) SELECT v.doc_id, round(coalesce(b.score,0)+v.c,5) AS score FROM v LEFT JOIN b ON b.doc_id=v.doc_id")
def rt23(spark, sf):
    """Lexical score and cosine plus one summed; every document matches."""
    v = document_vectors(spark, sf)
    q = V.query_vector(table(spark, sf, "embeddings"))
    c = V.scored(v, q).select("doc_id", (F.col("cos") + 1).alias("c"))
    return c.join(S.bm25(table(spark, sf, "documents"), "doc_id", "hale mahina", text="text"), "doc_id", "left").select("doc_id", F.round(F.coalesce("score", F.lit(0.0)) + F.col("c"), 5).alias("score"))


@op("rt24", f"WITH b AS (SELECT * FROM ({_BV}) t ORDER BY score DESC, doc_id LIMIT 10), k AS (SELECT doc_id, round((1+list_cosine_similarity(embedding::DOUBLE[],{_Q}))/2,6) AS s FROM {_VDOC} q ORDER BY s DESC, doc_id LIMIT 50) SELECT coalesce(b.doc_id,k.doc_id) AS doc_id, round(coalesce(b.score,0)+1.5*coalesce(k.s,0),5) AS score FROM b FULL JOIN k ON b.doc_id=k.doc_id")
def rt24(spark, sf):
    """The best lexical hits and five times as many neighbours, boosted, summed."""
    v = document_vectors(spark, sf)
    b = V.top_k(S.bm25(table(spark, sf, "documents"), "doc_id", "hale mahina", text="text"), "score", "doc_id", 10)
    k = V.scored(v, V.query_vector(table(spark, sf, "embeddings"))).select("doc_id", F.round((1 + F.col("cos")) / 2, 6).alias("s"))
    j = b.join(V.top_k(k, "s", "doc_id", 50), "doc_id", "full")
    return j.select("doc_id", F.round(F.coalesce("score", F.lit(0.0)) + 1.5 * F.coalesce("s", F.lit(0.0)), 5).alias("score"))


@op("rt25", f"WITH b AS (SELECT doc_id, score AS s FROM ({_BV}) t ORDER BY s DESC, doc_id LIMIT 100), k AS (SELECT doc_id, round((1+list_cosine_similarity(embedding::DOUBLE[],{_Q}))/2,6) AS s FROM {_VDOC} q ORDER BY s DESC, doc_id LIMIT 100), bn AS (SELECT doc_id,(s-min(s) OVER ())/(max(s) OVER ()-min(s) OVER ()) AS x FROM b), kn AS (SELECT doc_id,(s-min(s) OVER ())/(max(s) OVER ()-min(s) OVER ()) AS x FROM k) SELECT coalesce(bn.doc_id,kn.doc_id) AS doc_id, round(0.3*coalesce(bn.x,0)+0.7*coalesce(kn.x,0),5) AS score FROM bn FULL JOIN kn ON bn.doc_id=kn.doc_id")
def rt25(spark, sf):
    """Min-max normalised lists, weighted 0.3 lexical and 0.7 vector."""
    v = document_vectors(spark, sf)
    b = V.min_max(V.top_k(S.bm25(table(spark, sf, "documents"), "doc_id", "hale mahina", text="text"), "score", "doc_id", 100), "score", "x")
    k = V.scored(v, V.query_vector(table(spark, sf, "embeddings"))).select("doc_id", F.round((1 + F.col("cos")) / 2, 6).alias("s"))
    k = V.min_max(V.top_k(k, "s", "doc_id", 100), "s", "y")
    return b.join(k, "doc_id", "full").select("doc_id", F.round(0.3 * F.coalesce("x", F.lit(0.0)) + 0.7 * F.coalesce("y", F.lit(0.0)), 5).alias("score"))


@op("rt26", f"WITH b AS (SELECT doc_id, score AS s FROM ({_BV}) t ORDER BY s DESC, doc_id LIMIT 50), k AS (SELECT doc_id, round((1+list_cosine_similarity(embedding::DOUBLE[],{_Q}))/2,6) AS s FROM {_VDOC} q ORDER BY s DESC, doc_id LIMIT 50), u AS (SELECT doc_id, 1.0/(60+row_number() OVER (ORDER BY s DESC, doc_id)) AS r FROM b UNION ALL SELECT doc_id, 1.0/(60+row_number() OVER (ORDER BY s DESC, doc_id)) FROM k) SELECT doc_id, round(sum(r),8)::DOUBLE AS score FROM u GROUP BY 1")
def rt26(spark, sf):
    """Reciprocal-rank fusion of the two lists."""
    v = document_vectors(spark, sf)
    b = V.top_k(S.bm25(table(spark, sf, "documents"), "doc_id", "hale mahina", text="text"), "score", "doc_id", 50)
    k = V.scored(v, V.query_vector(table(spark, sf, "embeddings"))).select("doc_id", F.round((1 + F.col("cos")) / 2, 6).alias("score"))
    return V.rrf([b, V.top_k(k, "score", "doc_id", 50)], "doc_id")


@op("rt27", f"WITH s AS (SELECT label, vec_id, round({_COS}+1,6) AS score, row_number() OVER (PARTITION BY label ORDER BY round({_COS}+1,6) DESC, vec_id) AS rn FROM embeddings) SELECT label, max(score) AS score, count(*) AS hits FROM s WHERE rn<=5 GROUP BY 1")
def rt27(spark, sf):
    """Inner hits: the best five of each parent, the parent's score their highest."""
    e = table(spark, sf, "embeddings")
    s = V.scored(e, V.query_vector(e)).select("label", "vec_id", F.round(F.col("cos") + 1, 6).alias("score"))
    rn = F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return s.withColumn("rn", rn).where("rn <= 5").groupBy("label").agg(F.max("score").alias("score"), F.count("*").alias("hits"))


@op("rt28", f"SELECT doc_id, round(list_cosine_similarity(embedding::DOUBLE[],{_Q})+1,6) AS score FROM {_VDOC} q WHERE list_has_any({toks('text')},['hale']) OR contains(lower(text),'mahin')")
def rt28(spark, sf):
    """A match or a wildcard lets a document in; the cosine ranks it."""
    d = table(spark, sf, "documents")
    v = document_vectors(spark, sf, d.where(S.predicate(F.col("text"), "match", "hale") | F.lower("text").contains("mahin")))
    return V.scored(v, V.query_vector(table(spark, sf, "embeddings"))).select("doc_id", F.round(F.col("cos") + 1, 6).alias("score"))


@op("rt29", f"SELECT 'match' AS mode, sentenceid FROM {SENTS} WHERE list_has_any({toks()},['mahina','hou']) UNION ALL SELECT 'matchall', sentenceid FROM {SENTS} WHERE list_has_all({toks()},['mahina','hou']) UNION ALL SELECT 'phrase', sentenceid FROM {SENTS} WHERE contains(' '||array_to_string({toks()},' ')||' ',' mahina hou ')")
def rt29(spark, sf):
    """Every mode's hits under its name."""
    out = None
    for m in ("match", "matchall", "phrase"):
        x = S.search(sents(spark, sf), m, "mahina hou").select(F.lit(m).alias("mode"), "sentenceid")
        out = x if out is None else out.unionByName(x)
    return out


@op("rt30", f"WITH s AS (SELECT label, vec_id, round({_COS},6) AS sim FROM embeddings) SELECT label, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rn FROM s WHERE sim>=0.05) t WHERE rn<=3")
def rt30(spark, sf):
    """The three best snippets above a similarity, per hit."""
    e = table(spark, sf, "embeddings")
    s = V.scored(e, V.query_vector(e)).select("label", "vec_id", F.round("cos", 6).alias("sim")).where("sim >= 0.05")
    return s.withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy(F.desc("sim"), "vec_id"))).where("rn <= 3").drop("rn")


@op("rt31", "SELECT doc_id, list_filter(string_split(text,chr(10)||chr(10)), lambda x: regexp_matches(x,'(?i)mahina hou')) AS chunks FROM documents WHERE len(list_filter(string_split(text,chr(10)||chr(10)), lambda x: regexp_matches(x,'(?i)mahina hou')))>0")
def rt31(spark, sf):
    """Documents with the chunks that match."""
    c = F.filter(F.split("text", "\n\n"), lambda x: x.rlike("(?i)mahina hou"))
    return table(spark, sf, "documents").select("doc_id", c.alias("chunks")).where(F.size("chunks") > 0)


_MODES = """(VALUES ('elastic','match','match'),('elastic','matchall','matchall'),('elastic','phrase','phrase'),('elastic','term','term'),('elastic','regexp','regexp'),('elastic','wildcard','wildcard'),
('elastic','vector','vector'),('elastic','knn','knn'),('elastic','hybrid','hybrid'),('mysql','exact','phrase'),('mysql','any','match'),('mysql','all','matchall'),('mysql','regex','regexp'),
('postgres','any','match'),('postgres','all','matchall'),('postgres','exact','phrase'),('postgres','near','phrase'),('postgres','regex','regexp'),('postgres','hybrid','hybrid')) t(dialect, mode, meaning)"""


@op("rt32", f"SELECT * FROM {_MODES}")
def rt32(spark, sf):
    """The taxonomy of modes: what each store offers, and what a name of before means."""
    rows = [(k, m, S.mode_of(m)) for k, v in {"elastic": S.SENTENCE_MODES + S.VECTOR_MODES, **S.STORE_MODES}.items() for m in v]
    return spark.createDataFrame(rows, "dialect string, mode string, meaning string")


@op("rt33", f"SELECT sentenceid, hawaiiantext FROM {SENTS} WHERE list_has_any({toks()},['mahina'])")
def rt33(spark, sf):
    """An unknown mode falls back to match."""
    return S.search(sents(spark, sf), "no-such-mode", "mahina").select("sentenceid", H)


@op("rt34")
def rt34(spark, sf):
    """Embedding by a pluggable function; the local one hashes words to a unit vector."""
    from kilohana.operators.embed import hashed_embedding

    return table(spark, sf, "searchstats").where("searchterm IS NOT NULL").select("searchterm").distinct().select("searchterm", hashed_embedding(F.concat(F.lit("query: "), F.col("searchterm")), 64).alias("embedding"))


@op("rt35", """SELECT DISTINCT '{"match": ' || to_json(searchterm) || ', "terms": ' || to_json(string_split(lower(searchterm),' ')) || ', "size": ' || length(searchterm) || '}' AS query FROM searchstats WHERE searchterm IS NOT NULL""")
def rt35(spark, sf):
    """A query template filled for every search term: a string, an array and a number."""
    from kilohana.operators.embed import fill_columns

    s = table(spark, sf, "searchstats").where("searchterm IS NOT NULL").select("searchterm").distinct()
    q = fill_columns('{"match": "{{q}}", "terms": {{words}}, "size": {{n}}}', q=F.col("searchterm"), words=F.split(F.lower("searchterm"), " "), n=F.length("searchterm"))
    return s.select(q.alias("query"))
"""Re-ranking, highlights, snippets (RR) and windows (WN)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kilohana.functions import text as T
from kilohana.operators import rank as R
from kilohana.operators import search as S
from kilohana.operators import vector as V
from kilohana.plans.search import _COS, SENTS, sents, toks
from kilohana.plans.text import fold_sql
from kilohana.registry import both, op
from kilohana.session import table

H = "hawaiiantext"
_BOIL = " OR ".join(f"contains(lower({H}),'{p}')" for p in R.BOILER)
_PEN = f"(CASE WHEN strlen({H})>300 THEN 0.85 ELSE 1.0 END)::DOUBLE*(CASE WHEN {_BOIL} THEN 0.8 ELSE 1.0 END)::DOUBLE"
_LEN = f"least(strlen({H})/500.0::DOUBLE,1.0::DOUBLE)"
_SIM = "(sentenceid % 101)/100.0::DOUBLE"
_QUAL = "(sentenceid % 7)/7.0::DOUBLE"


@op("rr01", f"SELECT sentenceid, round((0.75::DOUBLE*{_SIM}+0.10::DOUBLE*{_QUAL}+0.15::DOUBLE*{_LEN})*{_PEN},6) AS score FROM {SENTS}")
def rr01(spark, sf):
    s = sents(spark, sf)
    return s.select("sentenceid", F.round(R.vector_sentence_score(F.col("sentenceid") % 101 / 100.0, F.col("sentenceid") % 7 / 7.0, F.col(H)), 6).alias("score"))


@op("rr02", f"SELECT sentenceid, round(((0.40*{_QUAL}+0.60*{_LEN})*{_PEN})::DOUBLE,6) AS score FROM {SENTS}")
def rr02(spark, sf):
    return sents(spark, sf).select("sentenceid", F.round(R.inner_hit_score(F.col("sentenceid") % 7 / 7.0, F.col(H)), 6).alias("score"))


@op("rr03", f"SELECT sentenceid, round(({_QUAL}*{_LEN})::DOUBLE,5) AS score FROM {SENTS}")
def rr03(spark, sf):
    return sents(spark, sf).select("sentenceid", F.round(R.lexical_sentence_score(F.col("sentenceid") % 7 / 7.0, F.col(H)), 5).alias("score"))


@op("rr04", f"SELECT sourceid, sentenceid FROM (SELECT *, row_number() OVER (PARTITION BY sourceid ORDER BY strlen(hawaiiantext) DESC, sentenceid) AS rn FROM {SENTS}) t WHERE rn=1")
def rr04(spark, sf):
    """The first hit of each source."""
    return R.first_per(sents(spark, sf), "sourceid", F.desc(F.octet_length(H)), "sentenceid").select("sourceid", "sentenceid")


@op("rr05", f"SELECT sentenceid, round((({_QUAL}*{_LEN}))::DOUBLE,5) AS score FROM (SELECT * FROM {SENTS} ORDER BY strlen(hawaiiantext) DESC, sentenceid LIMIT 50) q ORDER BY score DESC, sentenceid")
def rr05(spark, sf):
    """The engine's top k first, then the order by the combined score."""
    top = sents(spark, sf).orderBy(F.desc(F.octet_length(H)), "sentenceid").limit(50)
    return top.select("sentenceid", F.round(R.lexical_sentence_score(F.col("sentenceid") % 7 / 7.0, F.col(H)), 5).alias("score")).orderBy(F.desc("score"), "sentenceid")


@op("rr06", f"WITH s AS (SELECT sentenceid, strlen({H})::DOUBLE AS rel, 1-least(1.0,(CASE WHEN length({H})<40 THEN 0.5 ELSE 0.0 END)) AS q FROM {SENTS}) SELECT sentenceid, round((0.7*rel/max(rel) OVER ()+0.3*q/max(q) OVER ())::DOUBLE,5) AS score FROM s")
def rr06(spark, sf):
    """Relevance and quality, each over its maximum, 0.7 to 0.3."""
    s = sents(spark, sf).select("sentenceid", F.octet_length(H).cast("double").alias("rel"), (1 - F.when(F.length(H) < 40, 0.5).otherwise(0.0)).alias("q"))
    s = R.max_normalised(R.max_normalised(s, "rel", "a"), "q", "b")
    return s.select("sentenceid", F.round(0.7 * F.col("a") + 0.3 * F.col("b"), 5).alias("score"))


_PAD = r"regexp_replace(lower(hawaiiantext),'[^\p{L}\p{M}\p{N}_]+','  ','g')"


@op("rr07", rf"SELECT sentenceid, CAST(len(regexp_extract_all(' '||{_PAD}||' ',' hale ')) AS INTEGER) AS n FROM {SENTS}")
def rr07(spark, sf):
    return sents(spark, sf).select("sentenceid", R.token_hits(F.col(H), "hale").alias("n"))


_M1 = rf"regexp_replace({H}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(?i:(hale|mahina))($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1'||chr(1)||'\2'||chr(2)||'\3', 'g')"
_M2 = rf"regexp_replace({_M1}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_\x01])(?i:(hale|mahina))($|[^\p{{L}}\p{{M}}\p{{N}}_\x02])', '\1'||chr(1)||'\2'||chr(2)||'\3', 'g')"


@op("rr08", f"SELECT sentenceid, replace(replace({_M2},chr(1),'<mark>'),chr(2),'</mark>') AS t FROM {SENTS} WHERE list_has_any({toks()},['hale','mahina'])")
def rr08(spark, sf):
    """Whole words marked."""
    return S.search(sents(spark, sf), "match", "hale mahina").select("sentenceid", R.highlight(F.col(H), ["hale", "mahina"]).alias("t"))


@op("rr09", rf'''SELECT sentenceid, regexp_replace({H}, '(?i)(p[ʻ‘]*[oŌō]h[ʻ‘]*[aĀā]k[ʻ‘]*[uŪū])', '<span class="match">\1</span>', 'g') AS t FROM {SENTS} WHERE contains(lower({fold_sql()}),'pohaku')''')
def rr09(spark, sf):
    """Marks that take diacritics as they come."""
    s = sents(spark, sf).where(F.lower(T.fold(F.col(H))).contains("pohaku"))
    return s.select("sentenceid", R.highlight_loose(F.col(H), "pohaku").alias("t"))


_TERMS = r"list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace({e},'\\[a-zA-Z]|[\\^$.|?*+()\[\]{{}}]',' ','g'),'\p{{L}}[\p{{L}}ʻ]*'), lambda x: length(x)>=3)))"


@op("rr10", "SELECT DISTINCT e AS expr, " + _TERMS.format(e="e") + r" AS terms FROM (SELECT '^(' || searchterm || ')+[aeiou]{2}.*hale\b' AS e FROM searchstats WHERE searchterm IS NOT NULL) t")
def rr10(spark, sf):
    """Terms to mark for an expression, here one of every search term."""
    s = table(spark, sf, "searchstats").where("searchterm IS NOT NULL").select(F.concat(F.lit("^("), "searchterm", F.lit(r")+[aeiou]{2}.*hale\b")).alias("expr")).distinct()
    return s.select("expr", F.array_sort(R.regex_terms_column(F.col("expr"))).alias("terms"))


@op("rr11", rf'''SELECT sentenceid, regexp_replace({H}, '(?i)(ua [aeiouāēīōūʻhklmnpw]+)', '<span class="match">\1</span>', 'g') AS t FROM {SENTS} WHERE regexp_matches({H},'(?i)ua [aeiouāēīōūʻhklmnpw]+')''')
def rr11(spark, sf):
    rx = "(?iu)(ua [aeiouāēīōūʻhklmnpw]+)"
    return sents(spark, sf).where(F.col(H).rlike(rx)).select("sentenceid", F.regexp_replace(H, rx, '<span class="match">$1</span>').alias("t"))


def _snip(before: int, size: int) -> str:
    p, st = "instr(lower(text),'mahina')", f"greatest(instr(lower(text),'mahina')-1-{before},0)"
    return f"CASE WHEN {p}>0 THEN (CASE WHEN {st}>0 THEN '...' ELSE '' END)||substr(text,{st}+1,{size})||(CASE WHEN {st}+{size}<length(text) THEN '...' ELSE '' END) ELSE substr(text,1,{size})||(CASE WHEN length(text)>{size} THEN '...' ELSE '' END) END"


for _n, _b, _s in (("rr12", 200, 500), ("rr13", 100, 200), ("rr14", 75, 156)):

    def _run(spark, sf, _b=_b, _s=_s):
        return table(spark, sf, "documents").select("doc_id", R.snippet(F.col("text"), "mahina", _b, _s).alias("t"))

    op(_n, f"SELECT doc_id, {_snip(_b, _s)} AS t FROM documents")(_run)


@op("rr15", r"SELECT sourceid, regexp_replace(text,'(?i)(ka\s+mahina)','<mark>\1</mark>') AS t FROM contents WHERE regexp_matches(text,'(?i)ka\s+mahina')")
def rr15(spark, sf):
    """The first place of a phrase, white space aside, marked in its page."""
    rx = r"(?is)^(.*?)(ka\s+mahina)(.*)$"
    return table(spark, sf, "contents").where(F.col("text").rlike(r"(?i)ka\s+mahina")).select("sourceid", F.regexp_replace("text", rx, "$1<mark>$2</mark>$3").alias("t"))


@op("rr16", rf"SELECT sentenceid, array_to_string(list_transform(string_split({H},' '), lambda w: CASE WHEN lower({fold_sql('w')}) IN ('pohaku','hale') THEN '<b>'||w||'</b>' ELSE w END),' ') AS t FROM {SENTS}")
def rr16(spark, sf):
    """Word by word, equal after the fold."""
    mark = F.transform(F.split(H, " "), lambda w: F.when(F.lower(T.fold(w)).isin("pohaku", "hale"), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    return sents(spark, sf).select("sentenceid", F.array_join(mark, " ").alias("t"))


@op("rr17", f"SELECT s.sentenceid, x.link FROM {SENTS} LEFT JOIN (SELECT sourceid, max(link) AS link FROM sources GROUP BY 1) x ON x.sourceid=s.sourceid")
def rr17(spark, sf):
    """Every hit with its source's link, in one join."""
    x = table(spark, sf, "sources").groupBy("sourceid").agg(F.max("link").alias("link"))
    return sents(spark, sf).join(x, "sourceid", "left").select("sentenceid", "link")


@op("rr18", "SELECT groupname, coalesce(string_agg(DISTINCT authors, ', ' ORDER BY authors),'unknown') AS authors FROM sources WHERE groupname IS NOT NULL GROUP BY 1")
def rr18(spark, sf):
    a = F.array_join(F.array_sort(F.collect_set("authors")), ", ")
    return table(spark, sf, "sources").where("groupname IS NOT NULL").groupBy("groupname").agg(F.coalesce(F.nullif(a, F.lit("")), F.lit("unknown")).alias("authors"))


@op("rr19", f"SELECT sourceid, sentenceid FROM (SELECT *, row_number() OVER (PARTITION BY sourceid ORDER BY sentenceid, hawaiiantext) AS rn FROM {SENTS} WHERE list_contains({toks()},'mahina')) t WHERE rn=1 ORDER BY sentenceid LIMIT 20")
def rr19(spark, sf):
    """Documents by their first matching sentence."""
    return R.first_per(S.search(sents(spark, sf), "match", "mahina"), "sourceid", "sentenceid", H).orderBy("sentenceid").limit(20).select("sourceid", "sentenceid")


_HIST = "(SELECT wordcount, count(*) AS c FROM sentences WHERE wordcount IS NOT NULL GROUP BY 1)"


def _hist(spark, sf):
    return table(spark, sf, "sentences").where("wordcount IS NOT NULL").groupBy("wordcount").agg(F.count("*").alias("c"))


@op("wn01", f"SELECT wordcount, c, CAST(sum(c) OVER (ORDER BY wordcount) AS BIGINT) AS running FROM {_HIST} h")
def wn01(spark, sf):
    """Running total by word count; the window runs over the histogram, not the rows."""
    return _hist(spark, sf).withColumn("running", F.sum("c").over(W.orderBy("wordcount")))


@op("wn02", f"SELECT b, min(wordcount) AS lo, max(wordcount) AS hi, CAST(sum(c) AS BIGINT) AS c, CAST(sum(sum(c)) OVER (ORDER BY b) AS BIGINT) AS running FROM (SELECT wordcount//10 AS b, * FROM {_HIST} h) t GROUP BY b")
def wn02(spark, sf):
    g = _hist(spark, sf).groupBy(F.floor(F.col("wordcount") / 10).alias("b")).agg(F.min("wordcount").alias("lo"), F.max("wordcount").alias("hi"), F.sum("c").alias("c"))
    return g.withColumn("running", F.sum("c").over(W.orderBy("b")))


@op("wn03", "SELECT event_id, round(CASE WHEN max(value) OVER ()>0 THEN value/max(value) OVER () ELSE 0 END,6) AS x FROM events")
def wn03(spark, sf):
    return R.max_normalised(table(spark, sf, "events"), "value", "x").select("event_id", F.round("x", 6).alias("x"))


@op("wn04", "SELECT event_id, round((value-min(value) OVER ())/(max(value) OVER ()-min(value) OVER ()),6) AS x FROM events")
def wn04(spark, sf):
    return V.min_max(table(spark, sf, "events"), "value", "x").select("event_id", F.round("x", 6).alias("x"))


both("wn05", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM {embeddings}", "embeddings")
both("wn06", "SELECT groupname, sourceid FROM (SELECT groupname, sourceid, row_number() OVER (PARTITION BY groupname ORDER BY sourceid, title, created) AS rn FROM {sources}) t WHERE rn = 1", "sources")


@op("wn07", f"SELECT sourceid, sentenceid FROM (SELECT *, row_number() OVER (PARTITION BY sourceid ORDER BY sentenceid, hawaiiantext) AS rn FROM {SENTS}) t WHERE rn<=3")
def wn07(spark, sf):
    return R.first_n_per(sents(spark, sf), "sourceid", 3, "sentenceid", H).select("sourceid", "sentenceid")


@op("wn08", "SELECT sourceid, title FROM (SELECT *, row_number() OVER (PARTITION BY sourceid ORDER BY created DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM sources) t WHERE rn=1")
def wn08(spark, sf):
    """The latest delivery of each source."""
    return R.first_per(table(spark, sf, "sources"), "sourceid", F.desc_nulls_last("created"), F.desc_nulls_last("title")).select("sourceid", "title")

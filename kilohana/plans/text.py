"""Scalar functions over the sentence table (SF)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from kilohana.functions import gates as K
from kilohana.functions import text as T
from kilohana.registry import op
from kilohana.session import table
from kilohana.sources import readers

FOLD = "translate({c},'ōīēūāŌĪĒŪĀ‘ʻ','oieuaOIEUA')"
ALOWER = "translate({c},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
H = "hawaiiantext"


def fold_sql(c: str = H) -> str:
    return FOLD.format(c=c)


def scalar(name: str, fn, sql: str | None, tab: str = "sentences", key: str = "sentenceid", col: str = H) -> None:
    """Register ``fn`` over one text column: (key, v)."""

    def run(spark, sf):
        return table(spark, sf, tab).select(key, fn(F.col(col)).alias("v"))

    run.__name__ = name
    op(name, f"SELECT {key}, {sql} AS v FROM {tab}" if sql else None)(run)


TOK = rf"list_filter(string_split_regex({H}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
SPACE = r"list_filter(string_split_regex(trim({c}), '\s+'), lambda x: x <> '')"
ENTITY = rf"len(regexp_extract_all({H}, '\b[A-Z][a-z]+\b'))"
STOPS = ",".join(f"'{x}'" for x in T.ENGLISH_STOP)

scalar("sf01", T.fold, fold_sql())
scalar("sf02", T.fold_provider, f"translate({H},'ōīēūāŌĪĒŪĀ‘ʻ''','oieuaOIEUA')")
scalar("sf03", T.normalize_word, "trim(" + ALOWER.format(c=f"translate({H},'ōīēūāŌĪĒŪĀ''','oieuaOIEUA')") + ")")
scalar("sf04", T.word_count_spaces, f"CAST(length(trim(translate({H},',;','  '))) - length(replace(trim(translate({H},',;','  ')),' ','')) + 1 AS INTEGER)")
_W = rf"regexp_replace(trim({H}), '\s+', ' ', 'g')"
scalar("sf05", T.word_count, f"CAST(CASE WHEN {H} IS NULL OR {_W}='' THEN 0 ELSE length({_W})-length(replace({_W},' ',''))+1 END AS INTEGER)")
scalar("sf06", T.syllables, f"CAST(len(regexp_extract_all({fold_sql()}, '[aeiouAEIOU]+')) AS INTEGER)")
_R = rf"list_transform(string_split_regex(lower({H}), '\s+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}ʻ‘'']', '', 'g'))"
scalar("sf09", T.hawaiian_ratio_letters, f"len(list_filter({_R}, lambda x: regexp_matches(x,'[ʻ‘āēīōū]') OR regexp_matches(x,'^[aeiouhklmnpw]+$'))) / len({_R})")
scalar("sf11", T.entity_count, f"CAST({ENTITY} AS INTEGER)")
scalar(
    "sf12",
    T.entity_count_first,
    f"CAST(len(list_filter(regexp_extract_all({H},'[A-Z][a-z]+'), lambda x: x <> regexp_extract({H},'^([A-Za-z]+)',1))) AS INTEGER) + CAST(len(list_filter(regexp_extract_all({H},'[0-9]+'), lambda x: length(x)=4)) AS INTEGER)",
)
_ES = ",".join(f"'{x}'" for x in T.ENTITY_STOP)
scalar(
    "sf13",
    T.entity_count_position,
    rf"CAST(len(list_filter(string_split_regex(trim({H}), '\s+')[2:], lambda x: length(x)>1 AND regexp_matches(substr(x,1,1),'[A-ZĀĒĪŌŪ]') AND x <> upper(x) AND x NOT IN ({_ES}))) AS INTEGER)",
)
_BP = " OR ".join(f"contains(lower({H}),'{p}')" for p in T.BOILER_PHRASES)
scalar("sf14", T.boilerplate_phrases, f"round(least(1.0, (CASE WHEN length({H})<40 THEN 0.5 ELSE 0 END)+(CASE WHEN {ENTITY}=0 THEN 0.5 ELSE 0 END)+(CASE WHEN {_BP} THEN 0.2 ELSE 0 END)),2)::DOUBLE")
_SW = SPACE.format(c=f"lower({H})")
scalar("sf15", T.boilerplate_stopwords, f"CASE WHEN len({_SW})>0 THEN len(list_filter({_SW}, lambda x: x IN ({STOPS})))/len({_SW}) ELSE 0.0 END::DOUBLE")
scalar("sf16", T.boilerplate_short, f"((CASE WHEN length({H})<40 THEN 0.5 ELSE 0 END)+(CASE WHEN {ENTITY}=0 THEN 0.5 ELSE 0 END))::DOUBLE")
scalar("sf17", T.sentence_hash, "md5(" + ALOWER.format(c=f"trim({H})") + ")")
_M = r"string_split(regexp_replace({c}, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))"
scalar("sf18", T.split_sentences, "list_filter(" + _M.format(c="text") + ", lambda x: x <> '')", "documents", "doc_id", "text")
_P1 = r"regexp_replace(text, '(^|\s)(Mr|Mrs|Dr|St|No)\.', '\1\2[[DOT]]', 'g')"
_P2 = rf"regexp_replace({_P1}, '(^|\s)([A-Z])\.', '\1\2[[DOT]]', 'g')"
_PS = rf"list_filter(string_split(regexp_replace({_P2}, '([.?!])\s+([A-ZĀĒĪŌŪ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '')"
_PC = rf"list_filter(string_split_regex({_P2}, ',\s*'), lambda x: trim(x) <> '')"
scalar("sf19", T.split_protected, f"list_transform(CASE WHEN len({_PS})<2 THEN {_PC} ELSE {_PS} END, lambda x: replace(x,'[[DOT]]','.'))", "documents", "doc_id", "text")
scalar("sf20", T.clean_sentence, rf"regexp_replace(replace({H},'[[DOT]]','.'), '\s+([?!])', '\1', 'g')")
_IN = lambda xs: ",".join("'" + x.replace("'", "''") + "'" for x in xs)
_CONTAINS = lambda c, xs: "(" + " OR ".join(f"contains({c},'" + x.replace("'", "''") + "')" for x in xs) + ")"
_Q = lambda x: x.replace("'", "''")
_SWC = rf"len(list_filter(regexp_extract_all({H},'[A-Za-z''-]+'), lambda x: regexp_matches(x,'[A-Za-z]')))"
_SKIPPED = f"({_CONTAINS(H, K.SKIP)} OR {H} IN ({_IN(K.SKIP_EXACT)}) OR regexp_matches(trim({H}),'{_Q(K.LABEL)}'))"
scalar("sf22", K.accepted, f"contains({H},'‘') OR ({_SWC}>=1 AND NOT {_SKIPPED})")
scalar("sf23", K.accepted_hawaiian, f"{_SWC}>=1 AND NOT {_SKIPPED} AND (regexp_matches({H},'[''ʻ]') OR regexp_matches({H},'(?i){K._A}(?:{K.PLACES}){K._Z}') OR regexp_matches({H},'[āēīōūĀĒĪŌŪ]'))")

_KW = rf"list_transform(string_split_regex({ALOWER.format(c='t')},'\s+'), lambda x: regexp_replace(x,'[^\p{{L}}\p{{N}}_]','','g'))"
_LONG = f"list_filter({_KW}, lambda x: strlen(x)>2)"
_ENGLISH = f"""(NOT (regexp_matches(t,'[ʻāēīōū]') OR (subst>0 AND known/greatest(subst,1)>=0.3) OR {" OR ".join(f"regexp_matches(t,'{_Q(x)}')" for x in K.NOT_ENGLISH)} OR {_CONTAINS(ALOWER.format(c='t'), K.DIALECT)})
 AND (len(list_filter({_LONG}, lambda x: x IN ({_IN(K.ENGLISH)})))/greatest(len({_LONG}),1)>0.5 OR (regexp_matches(t,'{_Q(K.PLAIN_TEXT)}') AND NOT {_CONTAINS(ALOWER.format(c='t'), K.HAWAIIAN)} AND len({_LONG})>3)))"""
_PATTERN = "CASE " + " ".join(f"WHEN regexp_matches(t,'{_Q(p)}'){' AND known<2' if p == K.CAPITALS else ''} THEN {i}" for i, p in enumerate(K.PATTERNS, 1)) + " END"
_KEYS = "+".join(f"(contains(l,'{_Q(K._lower(k))}'))::INT" for k in K.KEYWORDS)
_JUDGED = rf"""x AS (SELECT sentenceid, regexp_replace({H},'^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$','','g') AS t FROM {{rows}} WHERE {H} IS NOT NULL),
k AS (SELECT sentenceid, translate(u,'āēīōūʻ`','aeiou') AS word FROM (SELECT sentenceid, unnest({_KW}) AS u FROM x) y WHERE strlen(u)>1),
n AS (SELECT k.sentenceid, count(dict.word) AS known, count(*) AS subst FROM k LEFT JOIN dict ON dict.word=k.word GROUP BY 1),
j AS (SELECT x.sentenceid, x.t, {ALOWER.format(c='x.t')} AS l, coalesce(known,0) AS known, coalesce(subst,0) AS subst FROM x LEFT JOIN n ON n.sentenceid=x.sentenceid)"""
_WORD = "trim(" + ALOWER.format(c=fold_sql("w")) + ")"


def _gate(name: str, col: str, sql: str, doc: str) -> None:
    def run(spark, sf):
        from kilohana.plans.search import sents

        rows = sents(spark, sf)
        dictionary = readers.word_list(table(spark, sf, "sources").where("title IS NOT NULL").select(F.col("title").alias("line")))
        return K.judged(rows, "sentenceid", H, dictionary).select("sentenceid", F.col(col).alias("v"))

    run.__doc__ = doc
    rows = f"(SELECT sentenceid, {H} FROM (SELECT *, row_number() OVER (PARTITION BY sentenceid ORDER BY created DESC NULLS LAST, {H} DESC NULLS LAST) AS rn FROM sentences) q WHERE rn=1) r"
    word = f"(SELECT word FROM (SELECT DISTINCT {_WORD} AS word FROM (SELECT unnest(string_split_regex(title,'[\\n, ]+')) AS w FROM sources WHERE title IS NOT NULL) z) y WHERE word NOT IN ('','a','i'))"
    op(name, f"WITH dict AS {word},{_JUDGED.replace('{rows}', rows)} SELECT sentenceid, {sql} AS v FROM j")(run)


_gate(
    "sf24",
    "reason",
    f"""CASE WHEN strlen(t)<8 THEN 'too_short (<8 chars)' WHEN strlen(t)<20 THEN CASE WHEN known>=2 OR known/greatest(len({_KW}),1)>=0.5 THEN NULL
 WHEN regexp_matches(t,'[ʻāēīōū]|{K._A}(?:{K.SHORT_WORDS}){K._Z}') THEN CASE WHEN regexp_matches(t,'(?i){K.CREDIT}') THEN 'English fragment' END ELSE 'short non-Hawaiian (<20 chars)' END
 ELSE coalesce('pattern ' || ({_PATTERN}), CASE {" ".join(f"WHEN regexp_matches(t,'{_Q(rx)}') THEN '{r}'" for r, rx in K.LATER)} WHEN len({_KW})>5 AND ({_KEYS})/len({_KW})>0.20 THEN 'publisher keywords' WHEN {_ENGLISH} THEN 'primarily English' END) END""",
    "Boilerplate: the first rule that rejects a sentence; the dictionary is the word list of titles.",
)
_gate("sf25", "english", _ENGLISH, "Primarily English: no diacritics, few dictionary words, no particle pairs, no dialect, and English words or plain letters only.")
scalar("sf26", T.ocr_clean, r"trim(regexp_replace(regexp_replace(regexp_replace(text,'(\p{L})-\s+(\p{Ll})','\1\2','g'),'\s+([,.;:?!])','\1','g'),'[ \t]+',' ','g'))", "documents", "doc_id", "text")
scalar("sf39", T.str_word_count, rf"CAST(len(list_filter(regexp_extract_all({H},'[A-Za-z''-]+'), lambda x: regexp_matches(x,'[A-Za-z]'))) AS INTEGER)")
scalar("sf42", lambda c: T.cut(T.strip_control(c)), r"substr(regexp_replace(title,'[\x00-\x1F\x7F]','','g'),1,140)", "sources", "sourceid", "title")


@op("sf07", f"WITH w AS (SELECT sentenceid, unnest({TOK}) AS t FROM sentences), d AS (SELECT DISTINCT {fold_sql('t')} AS k FROM w WHERE regexp_matches(t,'[āēīōū]')) SELECT w.sentenceid, count(*) AS n, sum(CASE WHEN d.k IS NOT NULL OR regexp_matches(w.t,'[āēīōū]') THEN 1 ELSE 0 END)/count(*) AS ratio FROM w LEFT JOIN d ON {fold_sql('w.t')}=d.k GROUP BY 1")
def sf07(spark, sf):
    """Dictionary ratio: tokens in the word list, or with a diacritic. The list: folded words that occur with a macron."""
    w = table(spark, sf, "sentences").select("sentenceid", F.explode(T.words_unicode(F.col(H))).alias("t")).withColumn("k", T.fold(F.col("t")))
    d = w.where(F.col("t").rlike("[āēīōū]")).select("k").distinct().withColumn("known", F.lit(1))
    hit = F.col("known").isNotNull() | F.col("t").rlike("[āēīōū]")
    return w.join(d, "k", "left").groupBy("sentenceid").agg(F.count("*").alias("n"), (F.sum(F.when(hit, 1).otherwise(0)) / F.count("*")).alias("ratio"))


_S8 = SPACE.format(c=H)


def _dictionary_ratio(name: str, key_fn, key_sql: str) -> None:
    sql = f"WITH w AS (SELECT sentenceid, unnest({_S8}) AS t FROM sentences), k AS (SELECT sentenceid, {key_sql} AS k FROM w), d AS (SELECT k FROM k GROUP BY k HAVING count(DISTINCT sentenceid)>=25) SELECT k.sentenceid, count(d.k)/count(*) AS ratio FROM k LEFT JOIN d ON k.k=d.k GROUP BY 1"

    def run(spark, sf):
        k = table(spark, sf, "sentences").select("sentenceid", F.explode(T.words_space(F.col(H))).alias("t")).select("sentenceid", key_fn(F.col("t")).alias("k"))
        d = k.groupBy("k").agg(F.countDistinct("sentenceid").alias("n")).where("n >= 25").select("k", F.lit(1).alias("known"))
        return k.join(d, "k", "left").groupBy("sentenceid").agg((F.count("known") / F.count("*")).alias("ratio"))

    run.__doc__ = "Ratio of words in the list of words of at least 25 sentences."
    op(name, sql)(run)


_dictionary_ratio("sf08", lambda c: F.lower(F.translate(c, "āēīōūĀĒĪŌŪ", "")), "lower(translate(t,'āēīōūĀĒĪŌŪ',''))")
_dictionary_ratio("sf10", T.normalize_word_marks, "trim(lower(translate(t,'ōīēūāŌĪĒŪĀ‘ʻ''','oieuaOIEUA')))")
_dictionary_ratio("sf45", T.normalize_word_marks, "trim(lower(translate(t,'ōīēūāŌĪĒŪĀ‘ʻ''','oieuaOIEUA')))")


def _chunks(name: str, fn, size: int, step: int, most: int | None) -> None:
    lim = f"least(greatest(ceil((length(text)-{size - step})/{step}),1),{most})" if most else f"greatest(ceil(length(text)/{size}),1)"

    def run(spark, sf):
        c = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(fn(F.col("text"))).alias("c"))
        return c.select("doc_id", F.col("c.chunk_index").alias("chunk_index"), F.col("c.chunk_start").alias("chunk_start"), F.length("c.chunk_text").alias("chunk_length"))

    op(name, f"SELECT doc_id, i::INTEGER AS chunk_index, (i*{step})::INTEGER AS chunk_start, length(substr(text,(i*{step}+1)::BIGINT,{size}))::INTEGER AS chunk_length FROM (SELECT doc_id,text,unnest(range(0,CAST({lim} AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL) t")(run)


_chunks("sf32", T.chunk, 30000, 30000, None)
_chunks("sf33", T.chunk_overlap, 30000, 29500, 20)


@op("sf34", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id=(SELECT min(vec_id) FROM embeddings)) b")
def sf34(spark, sf):
    """Cosine of every vector with the first."""
    from kilohana.operators.vector import query_vector

    e = table(spark, sf, "embeddings")
    return e.crossJoin(F.broadcast(query_vector(e))).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))


@op("sf35", "SELECT vec_id, len(embedding)=64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) AS ok FROM embeddings")
def sf35(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", T.valid_vector(F.col("embedding"), 64).alias("ok"))


@op("sf36", r"""WITH m AS (SELECT unnest(['Ianuali','Pepeluali','Malaki','Apelila','Mei','Iune','Iulai','Aukake','Kepakemapa','Okakopa','Nowemapa','Kekemapa']) AS mon, unnest(range(1,13)) AS n),
l AS (SELECT c.sourceid, i AS line_no, unnest_text AS line FROM (SELECT sourceid, unnest(range(1,len(string_split(text,chr(10)))+1)) AS i, unnest(string_split(text,chr(10))) AS unnest_text FROM contents WHERE text IS NOT NULL) c),
f AS (SELECT *, translate(line,'ōīēūāŌĪĒŪĀ‘ʻ','oieuaOIEUA') AS fl FROM l WHERE length(line)<60),
x AS (SELECT sourceid,line_no,regexp_extract(fl,'(\d{1,2}) (?:o )?([A-Z][a-z]+),? (\d{4})',1) AS d, regexp_extract(fl,'(\d{1,2}) (?:o )?([A-Z][a-z]+),? (\d{4})',2) AS mo, regexp_extract(fl,'(\d{1,2}) (?:o )?([A-Z][a-z]+),? (\d{4})',3) AS y, line FROM f)
SELECT sourceid, line_no, coalesce(CASE WHEN regexp_matches(line,'^\d{4}-\d{2}-\d{2}') THEN try_cast(substr(line,1,10) AS DATE) END, CASE WHEN m.n IS NOT NULL THEN make_date(try_cast(y AS INT),m.n::INT,try_cast(d AS INT)) END, CASE WHEN regexp_matches(line,'^\d{4}$') THEN make_date(try_cast(line AS INT),1,1) END) AS d
FROM x LEFT JOIN m ON x.mo=m.mon WHERE (m.n IS NOT NULL AND try_cast(d AS INT)<=28) OR regexp_matches(line,'^\d{4}-\d{2}-\d{2}') OR regexp_matches(line,'^\d{4}$')""")
def sf36(spark, sf):
    """Dates that lines of pages show."""
    lines = table(spark, sf, "contents").where("text IS NOT NULL").select("sourceid", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.length("line") < 60)
    out = lines.select("sourceid", (F.col("p") + 1).cast("long").alias("line_no"), T.parse_date(F.col("line")).alias("d"), "line")
    return out.where(F.col("d").isNotNull() & ((F.dayofmonth("d") <= 28) | F.col("line").rlike(r"^\d{4}"))).drop("line")


@op("sf37", "SELECT event_id, CAST(epoch_ms(event_id*100000000) AS DATE) AS d FROM events")
def sf37(spark, sf):
    """Milliseconds since 1970 as a date."""
    return table(spark, sf, "events").select("event_id", F.to_date(F.timestamp_millis(F.col("event_id") * 100000000)).alias("d"))


@op("sf38", "SELECT event_id, ts - INTERVAL 10 HOUR AS hst FROM events")
def sf38(spark, sf):
    """UTC to Honolulu, which keeps no summer time."""
    return table(spark, sf, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("Pacific/Honolulu"), F.col("ts")).alias("hst"))


@op("sf40", "SELECT log_id, CAST(json_extract(metadata,'$.chars') AS BIGINT) AS chars, json_extract_string(metadata,'$.parser') AS parser FROM processing_log WHERE metadata IS NOT NULL")
def sf40(spark, sf):
    j = F.from_json("metadata", "chars long, parser string")
    return table(spark, sf, "processing_log").where("metadata IS NOT NULL").select("log_id", j["chars"].alias("chars"), j["parser"].alias("parser"))


_NORM = r"regexp_replace(translate(lower(trim(authors)),'ʻ''',''),'\s+',' ','g')"


@op("sf41", f"SELECT DISTINCT authors, 'PERSON_' || substr(sha1('PERSON|' || {_NORM}),1,24) AS id FROM sources WHERE authors IS NOT NULL")
def sf41(spark, sf):
    """Entity ids of the authors."""
    s = table(spark, sf, "sources").where("authors IS NOT NULL").select("authors").distinct()
    return s.select("authors", T.entity_id(F.lit("PERSON"), F.col("authors")).alias("id"))


@op("sf43", r"SELECT DISTINCT trim(w) AS word FROM (SELECT unnest(string_split_regex(searchterm,'[\n, ]+')) AS w FROM searchstats) t WHERE trim(w) <> ''")
def sf43(spark, sf):
    """Words from lines and commas, trimmed, each once."""
    return table(spark, sf, "searchstats").select(F.explode(F.split("searchterm", r"[\n, ]+")).alias("word")).select(F.trim("word").alias("word")).where("word <> ''").distinct()


@op("sf44", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0)) + 1 - 1, 4) AS score FROM embeddings")
def sf44(spark, sf):
    from kilohana.operators.vector import query_vector

    e = table(spark, sf, "embeddings")
    return e.crossJoin(F.broadcast(query_vector(e))).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")) + 1 - 1, 4).alias("score"))


@op("sf46", f"SELECT sentenceid, CAST({ENTITY} AS INTEGER) AS v FROM sentences")
def sf46(spark, sf):
    """Entity count where no language model is at hand: capitalised words."""
    return table(spark, sf, "sentences").select("sentenceid", T.entity_count(F.col(H)).alias("v"))


@op("sf47", "SELECT sentenceid, 'passage: ' || hawaiiantext AS v FROM sentences")
def sf47(spark, sf):
    """The prefix that passage embeddings are computed with."""
    return table(spark, sf, "sentences").select("sentenceid", F.concat(F.lit("passage: "), F.col(H)).alias("v"))


@op("sf21")
def sf21(spark, sf):
    """Encoding repair: the table's entities by built-in replacements, the others decoded in Arrow batches, one mark for the okina."""
    from kilohana.operators.html import unescape

    return table(spark, sf, "contents").select("sourceid", T.one_okina(unescape(T.repair_entities(F.col("html")))).alias("html"))


@op("sf27")
def sf27(spark, sf):
    """Lines as units: initials and okina lines joined, long ones split, cut at 1000 bytes, up to an end marker. State runs over the lines, so in Arrow batches."""
    @F.pandas_udf("array<string>")
    def units(s: pd.Series) -> pd.Series:
        return s.map(T.unit_lines)

    return table(spark, sf, "contents").where("text IS NOT NULL").select("sourceid", F.posexplode(units("text")).alias("n", "line"))


@op("sf28", r"SELECT sourceid, unnest(string_split_regex(html,'(?i)<br\s*/?>')) AS part FROM contents WHERE html IS NOT NULL")
def sf28(spark, sf):
    return table(spark, sf, "contents").where("html IS NOT NULL").select("sourceid", F.explode(F.split("html", r"(?i)<br\s*/?>")).alias("part"))


_BRACKETS = r"(\([^()]*\)|\[[^\[\]]*\])|([.?!])(\s+)"


def split_outside_brackets(c):
    """Parts between sentence ends that stand outside brackets: brackets and ends are marked in one pass, and only ends with white space part the text."""
    marked = F.replace(F.regexp_replace(c, _BRACKETS, "$1$2\x02$3\x03"), F.lit("\x02\x03"), F.lit(""))
    return F.filter(F.transform(F.split(marked, "\x02\\s+\x03"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


@op("sf29", rf"""SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS part FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(regexp_replace(text,'{_BRACKETS}','\1\2'||chr(2)||'\3'||chr(3),'g'),chr(2)||chr(3),''),chr(2)||'\s+'||chr(3)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>'') AS p FROM documents WHERE text IS NOT NULL) t""")
def sf29(spark, sf):
    """Split at sentence ends that stand outside brackets (of one level); an unclosed bracket is a plain character."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(split_outside_brackets(F.col("text"))).alias("n", "part"))

"""HTML extraction (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilohana.operators import html as X
from kilohana.operators import rank as R
from kilohana.registry import both, op
from kilohana.session import table


def pages(spark, sf):
    return table(spark, sf, "contents").where("html IS NOT NULL").select("sourceid", "html")


@op("x01")
def x01(spark, sf):
    """Blocks of a parsed page in order."""
    return pages(spark, sf).select("sourceid", F.posexplode(X.paragraphs_udf("html")).alias("n", "block"))


@op("x02", r"SELECT sourceid, length(regexp_replace(regexp_replace(html,'(?is)<script\b[^>]*>.*?</script\s*>','','g'),'(?is)<style\b[^>]*>.*?</style\s*>','','g')) AS n FROM contents WHERE html IS NOT NULL")
def x02(spark, sf):
    return pages(spark, sf).select("sourceid", F.length(X.drop_elements(F.col("html"), "script", "style")).alias("n"))


@op("x03", r"""SELECT sourceid, md5(regexp_replace(html,'(href|src)="/','\1="http://site.example/','g')) AS h FROM contents WHERE html IS NOT NULL""")
def x03(spark, sf):
    return pages(spark, sf).select("sourceid", F.md5(X.absolute_links(F.col("html"), "http://site.example")).alias("h"))


@op("x04")
def x04(spark, sf):
    """The texts of //p, else of //body: what the first pattern that matches gives."""
    return pages(spark, sf).select("sourceid", F.posexplode(X.first_pattern_udf("html")).alias("n", "text"))


@op("x05")
def x05(spark, sf):
    """The page's paragraphs joined by blank lines."""
    return pages(spark, sf).select("sourceid", F.array_join(X.paragraphs_udf("html"), "\n\n").alias("text"))


def _meta_sql(what: str) -> str:
    e = ",".join("nullif(trim(regexp_extract(html,'" + rx.replace("'", "''") + "',1)),'')" for rx in X.META[what])
    return f"trim(regexp_replace(coalesce({e},''),'{X.LABEL}',''))"


@op("x06", f"""WITH s AS (SELECT sourceid, max(link) AS link FROM sources GROUP BY 1), m AS (SELECT c.sourceid, s.link, {_meta_sql('title')} AS title, {_meta_sql('date')} AS d, {_meta_sql('authors')} AS authors FROM contents c LEFT JOIN s ON s.sourceid=c.sourceid WHERE html IS NOT NULL),
n AS (SELECT *, coalesce(nullif(d,''), nullif(replace(regexp_extract(coalesce(link,''),'/(\\d{{4}}/\\d{{2}}/\\d{{2}})/',1),'/','-'),''), '') AS date FROM m)
SELECT sourceid, title, date, authors, coalesce(regexp_extract(link,'^https?://([^/]+)',1),'') || ': ' || date AS sourcename FROM n""".replace("\\\\", "\\"))
def x06(spark, sf):
    """A page's metadata: title (heading, og:title, title), date (published_time, else the address), author without its label, and the name made of them."""
    s = table(spark, sf, "sources").groupBy("sourceid").agg(F.max("link").alias("link"))
    p = pages(spark, sf).join(s, "sourceid", "left")
    in_url = F.replace(F.regexp_extract(F.coalesce("link", F.lit("")), r"/(\d{4}/\d{2}/\d{2})/", 1), F.lit("/"), F.lit("-"))
    date = F.coalesce(F.nullif(X.meta(F.col("html"), "date"), F.lit("")), F.nullif(in_url, F.lit("")), F.lit(""))
    m = p.select("sourceid", "link", X.meta(F.col("html"), "title").alias("title"), date.alias("date"), X.meta(F.col("html"), "authors").alias("authors"))
    host = F.coalesce(F.regexp_extract("link", r"^https?://([^/]+)", 1), F.lit(""))
    return m.select("sourceid", "title", "date", "authors", F.concat(host, F.lit(": "), "date").alias("sourcename"))


@op("x07", r"""SELECT DISTINCT unnest(regexp_extract_all(html,'href="([^"]+)"',1)) AS link FROM contents WHERE html IS NOT NULL""")
def x07(spark, sf):
    return pages(spark, sf).select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'))).alias("link")).distinct()


both("x08", "SELECT sourceid, length(html) AS chars, length(text) AS text_chars, wordcount FROM {contents}", "contents")


@op("x09", r"SELECT sourceid, array_to_string(list_filter(string_split(text,chr(10)), lambda x: trim(x)<>'' AND NOT regexp_matches(x,'^\s*(?:\(No text\)|Page \d+|[\d\s.,;:-]+|[IVXLCDM]+)\s*$')),chr(10)) AS t FROM contents WHERE text IS NOT NULL")
def x09(spark, sf):
    """Lines without page labels, figures and Roman numerals."""
    keep = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(?:\(No text\)|Page \d+|[\d\s.,;:-]+|[IVXLCDM]+)\s*$"))
    return table(spark, sf, "contents").where("text IS NOT NULL").select("sourceid", F.array_join(keep, "\n").alias("t"))


_CP = {k: v.replace("'", "''") for k, v in X.CARD_PARTS.items()}


@op("x10", rf"""WITH b AS (SELECT sourceid, unnest(string_split_regex(html,'{X.CARD}')[2:]) AS x FROM contents WHERE html IS NOT NULL),
g AS (SELECT sourceid, regexp_extract(x,'{_CP["url"]}',1) AS url, regexp_extract(x,'{_CP["title"]}',1) AS ti, regexp_extract(x,'{_CP["text"]}',1) AS te, regexp_extract(x,'{_CP["image"]}',1) AS image, regexp_extract(x,'{_CP["authors"]}',1) AS au FROM b)
SELECT sourceid, regexp_replace(trim(CASE WHEN ti<>'' THEN ti ELSE te END),'^Column:\s*','') AS title, url, image, trim(regexp_replace(au,'{X.LABEL}','')) AS authors, replace(regexp_extract(url,'/(\d{{4}}/\d{{2}}/\d{{2}})/',1),'/','-') AS date FROM g WHERE url<>''""".replace("\\", "\\"))
def x10(spark, sf):
    """Article cards with title, address, image, authors and date."""
    c = pages(spark, sf).select("sourceid", F.explode(X.cards(F.col("html"))).alias("c"))
    return c.select("sourceid", "c.title", "c.url", "c.image", "c.authors", "c.date")


@op("x11", r"""WITH RECURSIVE s AS (SELECT DISTINCT sourceid, link FROM sources WHERE link IS NOT NULL),
e AS (SELECT DISTINCT s.link AS src, CASE WHEN starts_with(h,'/') THEN regexp_extract(s.link,'^(https?://[^/]+)',1)||h ELSE h END AS dst FROM (SELECT sourceid, unnest(regexp_extract_all(html,'href="([^"#]+)"',1)) AS h FROM contents WHERE html IS NOT NULL) c JOIN s ON s.sourceid=c.sourceid),
r AS (SELECT link AS url FROM s UNION SELECT e.dst FROM r JOIN e ON e.src=r.url) SELECT DISTINCT url FROM r""")
def x11(spark, sf):
    """Stored links followed from every source until no address is new."""
    s = table(spark, sf, "sources").where("link IS NOT NULL").select("sourceid", "link").distinct()
    h = pages(spark, sf).select("sourceid", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'))).alias("h")).join(s, "sourceid")
    dst = F.when(F.col("h").startswith("/"), F.concat(F.regexp_extract("link", r"^(https?://[^/]+)", 1), "h")).otherwise(F.col("h"))
    return X.follow(h.select(F.col("link").alias("src"), dst.alias("dst")).distinct(), s.select(F.col("link").alias("url")))


@op("x12", "SELECT doc_id, 'http://pages.example/?a=d&d=OID' || doc_id || '.1.' || k || '&srpos=&dliv=none&st=1' || CASE WHEN doc_id % 2 = 0 THEN '&e=haw' ELSE '' END AS url FROM documents, (VALUES (1), (2), (3)) t(k) WHERE link IS NOT NULL AND k <= 1 + doc_id % 3")
def x12(spark, sf):
    """A document's pages as addresses, from the page titles and the id in its first page's script."""
    d = table(spark, sf, "documents").where("link IS NOT NULL")
    titles = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), lambda k: F.concat(F.lit("'1."), k.cast("string"), F.lit("':'Page "), k.cast("string"), F.lit("'"))), ",\n")
    html = F.concat(F.lit("<script>var pageTitles = {"), titles, F.lit('};\nvar d = {"documentOID" : "OID'), F.col("doc_id").cast("string"), F.lit('"};</script>'))
    url = F.concat("link", F.when(F.col("doc_id") % 2 == 0, "?a=d&e=haw").otherwise("?a=d"))
    return d.select("doc_id", F.explode(X.page_urls(html, url, "http://pages.example/")).alias("url"))


@op("x13")
def x13(spark, sf):
    """Chapter text with line breaks only."""
    return pages(spark, sf).select("sourceid", X.chapter_html(F.col("html")).alias("t")).where("t <> ''")


@op("x14", "SELECT sourcename, sourceid FROM (SELECT sourcename, sourceid, row_number() OVER (PARTITION BY sourcename ORDER BY sourceid, created NULLS FIRST) AS rn FROM sources WHERE date IS NOT NULL AND NOT contains(link,'pukehohonu')) t WHERE rn=1 ORDER BY sourceid LIMIT 200")
def x14(spark, sf):
    """A catalog: dated, not on the black list, first of a name, up to a limit."""
    s = table(spark, sf, "sources").where("date IS NOT NULL AND NOT contains(link, 'pukehohonu')")
    return R.first_per(s, "sourcename", "sourceid", "created").orderBy("sourceid").limit(200).select("sourcename", "sourceid")


@op("x15", r"WITH l AS (SELECT DISTINCT CASE WHEN sourceid%2=0 THEN link || '?a=d&d=' || sourceid || '.7&e=x' ELSE link || '.html' END AS url FROM sources WHERE link IS NOT NULL) SELECT url, regexp_extract(url,'^https?://([^/]+)',1) AS host, CASE WHEN regexp_matches(url,'[?&]d=') THEN regexp_extract(url,'[?&]d=([^&]*)',1) ELSE regexp_replace(regexp_extract(url,'([^/?]+)(?:\?|$)',1),'\.[^.]*$','') END AS oid FROM l")
def x15(spark, sf):
    """The id in an address: the query parameter d, else the file's name without its ending."""
    url = F.when(F.col("sourceid") % 2 == 0, F.concat("link", F.lit("?a=d&d="), F.col("sourceid").cast("string"), F.lit(".7&e=x"))).otherwise(F.concat("link", F.lit(".html")))
    s = table(spark, sf, "sources").where("link IS NOT NULL").select(url.alias("url")).distinct()
    name = F.regexp_replace(F.regexp_extract(F.parse_url(F.col("url"), F.lit("PATH")), r"([^/]+)$", 1), r"\.[^.]*$", "")
    return s.select("url", F.parse_url(F.col("url"), F.lit("HOST")).alias("host"), F.coalesce(F.parse_url(F.col("url"), F.lit("QUERY"), F.lit("d")), name).alias("oid"))


@op("x16")
def x16(spark, sf):
    """Pages rendered to clean text."""
    return pages(spark, sf).select("sourceid", X.unescape(X.clean_pages(F.col("html"))).alias("t"))
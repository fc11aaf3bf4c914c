"""HTML by built-in expressions where they can, by Arrow batches and a parser where they cannot."""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohana.session import cut_lineage

ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def drop_elements(c: Column, *tags: str) -> Column:
    for t in tags:
        c = F.regexp_replace(c, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "")
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<[^>]*>", " ")


def absolute_links(c: Column, base: str) -> Column:
    return F.regexp_replace(c, r'(href|src)="/', f'$1="{base}/')


def title(c: Column) -> Column:
    return F.regexp_extract(c, r"(?is)<title>(.*?)</title>", 1)


class _Paragraphs(HTMLParser):
    def __init__(self, tags: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.out, self.buf, self.mute = tags, [], [], 0

    def flush(self) -> None:
        t = " ".join("".join(self.buf).split())
        if t:
            self.out.append(t)
        self.buf = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        elif tag in self.tags or tag == "br":
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag in self.tags:
            self.flush()

    def handle_data(self, data):
        if not self.mute:
            self.buf.append(data)


def paragraphs(html: str | None) -> list[str]:
    """Texts of block elements in order; broken markup is read as far as it goes."""
    if not html:
        return []
    p = _Paragraphs({"p", "div", "td", "li", "h1", "h2", "h3", "article", "section", "footer", "nav", "aside", "title"})
    p.feed(html)
    p.close()
    p.flush()
    return p.out


def paragraphs_udf(c: str) -> Column:
    """paragraphs over a column, in Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(paragraphs)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(c)


#: An ad's or menu's own words for a page's label; what stands before a title or an author.
LABEL = r"^(?:Column:\s*|By na |By |Na )"
_P_ENDS = {"p", "div", "td", "tr", "table", "li", "ul", "ol", "h1", "h2", "h3", "h4", "article", "section", "footer", "nav", "aside", "header", "body", "html"}


class _Elements(HTMLParser):
    """Texts of the ``p`` elements, and of the whole body; an open p ends where another block begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.ps: list[str] = []
        self.body: list[str] = []
        self.buf: list[str] | None = None
        self.mute, self.inside = 0, False

    def close_p(self) -> None:
        if self.buf is not None and (t := " ".join("".join(self.buf).split())):
            self.ps.append(t)
        self.buf = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.mute += 1
        self.inside |= tag == "body"
        if tag in _P_ENDS:
            self.close_p()
            self.body.append(" ")
        if tag == "br":
            self.body.append(" ")
            if self.buf is not None:
                self.buf.append(" ")
        if tag == "p":
            self.buf = []

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.mute = max(0, self.mute - 1)
        elif tag in _P_ENDS:
            self.close_p()

    def handle_data(self, data):
        if not self.mute:
            if self.inside:
                self.body.append(data)
            if self.buf is not None:
                self.buf.append(data)


def first_pattern(html: str | None) -> list[str]:
    """The texts of //p, or of //body where there is no p."""
    if not html:
        return []
    p = _Elements()
    p.feed(html)
    p.close()
    p.close_p()
    body = " ".join("".join(p.body).split())
    return p.ps or ([body] if body else [])


def _series(fn, kind: str, c: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(c)


def first_pattern_udf(c: Column | str) -> Column:
    return _series(first_pattern, "array<string>", c)


def unescape(c: Column | str) -> Column:
    """Entities decoded, in Arrow batches; null stays null."""
    return _series(lambda x: None if x is None else _html.unescape(x), "string", c)


#: A page's metadata: expressions whose first group is the value, those before win.
META = {
    "title": [r'(?is)<h1\b[^>]*class="[^"]*(?:page|story)-title[^"]*"[^>]*>([^<]*)', r"(?is)<h1\b[^>]*>([^<]*)", r'(?is)<meta\b[^>]*property="og:title"[^>]*content="([^"]*)"', r"(?is)<title\b[^>]*>([^<]*)"],
    "date": [r'(?is)<meta\b[^>]*property="article:published_time"[^>]*content="([^"T]*)'],
    "authors": [r'(?is)<meta\b[^>]*property="article:author"[^>]*content="([^"]*)"', r'(?is)<(?:p|li|span)\b[^>]*class="[^"]*(?:author|byline)[^"]*"[^>]*>([^<]*)'],
}


def meta(c: Column, what: str) -> Column:
    """A metadata value of a page, white space trimmed and labels off; '' without one."""
    e = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, rx, 1)), F.lit("")) for rx in META[what]], F.lit(""))
    return F.trim(F.regexp_replace(e, LABEL, ""))


#: A card begins at an element of this kind, and shows its parts by these expressions.
CARD = r"(?i)<(?:article|aside)\b"
CARD_PARTS = {"url": r'(?is)<a\b[^>]*href="([^"]+)"', "title": r'(?is)<a\b[^>]*title="([^"]+)"', "text": r'(?is)<a\b[^>]*href="[^"]+"[^>]*>([^<]*)', "image": r'(?is)<img\b[^>]*src="([^"]+)"', "authors": r'(?is)class="[^"]*byline[^"]*"[^>]*>(?:\s*<li\b[^>]*>)?([^<]*)', "day": r"\b([A-Z][a-z]{2})\.? (\d{1,2}), (\d{4})\b"}
MONTHS3 = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def cards(c: Column) -> Column:
    """array<struct<title, url, image, authors, date>>: the article cards of a page that link somewhere, in order.

    The title is the link's title attribute, else its text; the date that of the address, else the card's ``M. j, Y``.
    """
    parts = F.split(c, CARD)
    blocks = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(x):
        get = {k: F.regexp_extract(x, rx, 1) for k, rx in CARD_PARTS.items() if k != "day"}
        title = F.regexp_replace(F.trim(F.when(get["title"] != "", get["title"]).otherwise(get["text"])), r"^Column:\s*", "")
        in_url = F.regexp_extract(get["url"], r"/(\d{4}/\d{2}/\d{2})/", 1)
        mon = F.try_element_at(F.create_map(*[y for m, i in MONTHS3.items() for y in (F.lit(m), F.lit(i))]), F.regexp_extract(x, CARD_PARTS["day"], 1))
        d, y = (F.try_to_number(F.nullif(F.regexp_extract(x, CARD_PARTS["day"], k), F.lit("")), F.lit("9999")).cast("int") for k in (2, 3))
        date = F.when(in_url != "", F.replace(in_url, F.lit("/"), F.lit("-"))).when(mon.isNotNull(), F.format_string("%04d-%02d-%02d", y, mon, d)).otherwise("")
        return F.struct(title.alias("title"), get["url"].alias("url"), get["image"].alias("image"), F.trim(F.regexp_replace(get["authors"], LABEL, "")).alias("authors"), date.alias("date"))

    return F.filter(F.transform(blocks, one), lambda s: s["url"] != "")


def page_urls(html: Column, url: Column, base: str) -> Column:
    """array<string>: the addresses of a document's pages from the map of page titles and the document's id in its first page; else the page itself."""
    inner = F.regexp_extract(html, r"(?s)pageTitles.*?\{(.*?)\}", 1)
    titles = F.from_json(F.concat(F.lit("{"), F.replace(F.replace(inner, F.lit("\n"), F.lit("")), F.lit("'"), F.lit('"')), F.lit("}")), "map<string,string>")
    oid = F.regexp_extract(html, r'"documentOID"\s*:\s*"([^"]+)', 1)
    e = F.regexp_extract(url, r"[?&]e=([^&]*)", 1)
    tail = F.when(e != "", F.concat(F.lit("&e="), e)).otherwise("")
    pages = F.transform(F.map_keys(titles), lambda k: F.concat(F.lit(base + "?a=d&d="), oid, F.lit("."), k, F.lit("&srpos=&dliv=none&st=1"), tail))
    return F.when((oid == "") | titles.isNull() | (F.size(titles) == 0), F.array(url)).otherwise(pages)


def chapter_html(c: Column) -> Column:
    """A chapter's page with <br /> only: book and chapter links out, titles on lines of their own, repeated book names before a number out; '' below 11 bytes."""
    e = F.regexp_replace(c, r'(?is)<a\b(?=[^>]*href="[^"]*d=NULL)(?=[^>]*target="[^"]*main)[^>]*>.*?</a\s*>', "")
    e = F.regexp_replace(e, r"<p[^>]*><span[^>]*>([^<]+)</span></p>", "<br />$1<br />")
    e = F.regexp_replace(drop_elements(e, "script", "style", "head"), r"(?is)<(?!br\b)[^>]*>", "")
    e = F.regexp_replace(unescape(F.trim(e)), r"\b([A-Za-z]+)\s+\1\s+\d+\b", "")
    e = F.regexp_replace(F.regexp_replace(e, r"\s+", " "), r"(?i)\s*<br\s*/?>\s*", "<br />")
    return F.when(F.octet_length(e) > 10, e).otherwise("")


DROPPED = [r"(?iu)^\(No text\)$", r"^Page \d{1,4}$", r"^[\s()/'0-9;.,–—\-]+$", r"^\s*[ivxlcdmIVXLCDM]+\s*$"]


def clean_pages(c: Column, page: str = r"(?i)<(?:div|table)\b[^>]*>") -> Column:
    """A page set rendered to text: a section for each page element, its line breaks kept, labels, figures and Roman numerals out, lines and sections apart by a blank line."""
    e = F.regexp_replace(drop_elements(c, "script", "style", "head"), r"(?i)<br\s*/?>|</(?:p|td|tr|div|span|li|h\d)\s*>", "\n")
    sections = F.split(e, page)

    def clean(s):
        lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(s, r"(?s)<[^>]*>", ""), r"[^\S\n]{2,}", " "), r"\n"), lambda x: F.trim(x))
        ok = lambda x: (x != "") & ~x.rlike("|".join(f"(?:{rx})" for rx in DROPPED))
        return F.array_join(F.filter(lines, ok), "\n\n")

    return F.array_join(F.filter(F.transform(sections, clean), lambda x: x != ""), "\n\n")


def follow(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url) of everything that links reach from the seeds: (src, dst) are followed until nothing is new. Visited addresses leave by anti-join, each round is cut."""
    seen = cut_lineage(seeds.select("url").distinct())
    front = seen
    while True:
        front = cut_lineage(front.join(edges, front["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(front))

"""Text scalars as Columns. All are built-in expressions, so they stay within whole-stage code generation.

The reference world has several functions of one name with different rules (word ratio, entity count, boilerplate score, word count); each stands here under
its own name. "ASCII lower" is what byte-wise string functions do: only A-Z change.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a macron and their plain forms, and the two marks written for the okina. Fixed values.
MACRON, PLAIN = "ōīēūāŌĪĒŪĀ", "oieuaOIEUA"
OKINA = "‘ʻ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """Diacritics off, case kept: the fold that the stored simplified column uses."""
    return F.translate(c, MACRON + OKINA, PLAIN)


def fold_provider(c: Column) -> Column:
    """fold, and the ASCII apostrophe off."""
    return F.translate(c, MACRON + OKINA + "'", PLAIN)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def normalize_word(c: Column) -> Column:
    """Word-list key: apostrophe off, macrons plain, ASCII lower, trimmed; the okina stays."""
    return F.trim(ascii_lower(F.translate(c, MACRON + "'", PLAIN)))


def normalize_word_marks(c: Column) -> Column:
    """The indexer's key: both okina marks and the apostrophe off as well."""
    return F.trim(F.lower(F.translate(c, MACRON + OKINA + "'", PLAIN)))


def word_count_spaces(c: Column) -> Column:
    """Spaces plus one after commas and semicolons became spaces; doubled spaces inflate it."""
    s = F.trim(F.translate(c, ",;", "  "))
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("int")


def word_count(c: Column) -> Column:
    """White space collapsed, spaces plus one; null or blank is 0."""
    s = F.regexp_replace(F.trim(c), r"\s+", " ")
    return F.when(c.isNull() | (s == ""), 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("int")


def syllables(c: Column) -> Column:
    """Runs of vowels after the fold."""
    return F.regexp_count(fold(c), F.lit("[aeiouAEIOU]+"))


def words_unicode(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def words_space(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def _share(arr: Column, test) -> Column:
    return F.when(F.size(arr) > 0, F.size(F.filter(arr, test)) / F.size(arr)).otherwise(F.lit(0.0))


def hawaiian_ratio_letters(c: Column) -> Column:
    """Ratio without a dictionary: a token counts when it has a diacritic or only letters of the Hawaiian alphabet."""
    toks = F.transform(F.split(F.lower(c), r"\s+"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}ʻ‘']", ""))
    ok = lambda x: x.rlike("[ʻ‘āēīōū]") | x.rlike("^[aeiouhklmnpw]+$")
    return _share(toks, ok)


def entity_count(c: Column) -> Column:
    """Capitalised ASCII words, with ASCII word boundaries."""
    return F.regexp_count(c, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?![A-Za-z0-9_])"))


def entity_count_first(c: Column) -> Column:
    """Capitalised words other than the sentence's first word, and four-digit years."""
    names = F.regexp_extract_all(c, F.lit(r"[A-Z][a-z]+"), F.lit(0))
    first = F.regexp_extract(c, r"^([A-Za-z]+)", 1)
    return F.size(F.filter(names, lambda x: x != first)) + F.regexp_count(c, F.lit(r"(?<![0-9])[0-9]{4}(?![0-9])"))


ENTITY_STOP = "The A An And But Or He She It They We I You This That In On At Ua Ke Ka".split()


def entity_count_position(c: Column) -> Column:
    """Tokens after the first with a capital initial, not all capitals, not in the stop list, longer than one character."""
    toks = F.split(F.trim(c), r"\s+")
    rest = F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0)))
    ok = lambda x: (F.length(x) > 1) & F.substring(x, 1, 1).rlike("[A-ZĀĒĪŌŪ]") & (x != F.upper(x)) & ~x.isin(ENTITY_STOP)
    return F.size(F.filter(rest, ok))


BOILER_PHRASES = ["click here", "all rights reserved", "share this", "log in", "reprinted", "subscribe"]
ENGLISH_STOP = "the of and to in is for that with on as by at from or be".split()


def boilerplate_phrases(c: Column) -> Column:
    """Short 0.5, no entity 0.5, first listed phrase 0.2; at most 1, two decimals."""
    has = F.lit(False)
    for p in BOILER_PHRASES:
        has = has | F.lower(c).contains(p)
    s = F.when(F.length(c) < 40, 0.5).otherwise(0.0) + F.when(entity_count(c) == 0, 0.5).otherwise(0.0) + F.when(has, 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), s), 2)


def boilerplate_stopwords(c: Column) -> Column:
    """Share of English stop words."""
    return _share(words_space(F.lower(c)), lambda x: x.isin(ENGLISH_STOP))


def boilerplate_short(c: Column) -> Column:
    """Short or without entities."""
    return F.when(F.length(c) < 40, 0.5).otherwise(0.0) + F.when(entity_count(c) == 0, 0.5).otherwise(0.0)


def sentence_hash(c: Column) -> Column:
    """md5 of the trimmed ASCII-lower text."""
    return F.md5(ascii_lower(F.trim(c)))


MARK = "\u0001"


def split_sentences(c: Column) -> Column:
    """Split after . ? ! and white space; no empty parts."""
    return F.filter(F.split(F.regexp_replace(c, r"([.?!])\s+", "$1" + MARK), MARK), lambda x: x != "")


ABBREV = ["Mr", "Mrs", "Dr", "St", "No"]
DOT = "[[DOT]]"


def split_protected(c: Column) -> Column:
    """Abbreviations and initials keep their dots; split before a capital that is no okina; fewer than two parts: split at commas."""
    p = F.regexp_replace(c, rf"(^|\s)({'|'.join(ABBREV)})\.", "$1$2" + DOT.replace("[", r"\[").replace("]", r"\]"))
    p = F.regexp_replace(p, r"(^|\s)([A-Z])\.", "$1$2" + DOT)
    parts = F.filter(F.split(F.regexp_replace(p, r"([.?!])\s+([A-ZĀĒĪŌŪ])", "$1" + MARK + "$2"), MARK), lambda x: F.trim(x) != "")
    parts = F.when(F.size(parts) < 2, F.filter(F.split(p, r",\s*"), lambda x: F.trim(x) != "")).otherwise(parts)
    return F.transform(parts, lambda x: F.replace(x, F.lit(DOT), F.lit(".")))


def clean_sentence(c: Column) -> Column:
    """Protected dots back, no space before ? and !."""
    return F.regexp_replace(F.replace(c, F.lit(DOT), F.lit(".")), r"\s+([?!])", "$1")


OCR_FIXES = [("ii a", "i a"), ("1a", "la"), ("0 ", "o "), ("  ", " ")]


def ocr_clean(c: Column) -> Column:
    e = F.regexp_replace(c, r"(\p{L})-\s+(\p{Ll})", "$1$2")
    e = F.regexp_replace(e, r"\s+([,.;:?!])", "$1")
    return F.trim(F.regexp_replace(e, r"[ \t]+", " "))


CONTROL = "[\\x00-\\x1F\\x7F]"


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def cut(c: Column, n: int = 140) -> Column:
    return F.substring(c, 1, n)


def str_word_count(c: Column) -> Column:
    """Runs of ASCII letters, apostrophes and hyphens that hold a letter."""
    return F.size(F.filter(F.regexp_extract_all(c, F.lit(r"[A-Za-z'-]+"), F.lit(0)), lambda x: x.rlike("[A-Za-z]")))


def chunk(c: Column, size: int = 30000) -> Column:
    """Pieces of ``size`` characters, no overlap."""
    n = F.greatest(F.ceil(F.length(c) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk_index"), (i * size).alias("chunk_start"), F.substring(c, i * size + 1, F.lit(size)).alias("chunk_text")))


def chunk_overlap(c: Column, size: int = 30000, overlap: int = 500, most: int = 20) -> Column:
    """Pieces with an overlap, at most ``most`` of them."""
    step = size - overlap
    n = F.least(F.greatest(F.ceil((F.length(c) - overlap) / step), F.lit(1)), F.lit(most)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk_index"), (i * step).alias("chunk_start"), F.substring(c, i * step + 1, F.lit(size)).alias("chunk_text")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    nb = F.sqrt(F.aggregate(F.transform(b, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def valid_vector(c: Column, dims: int) -> Column:
    return (F.size(c) == dims) & ~F.exists(c, lambda x: F.isnan(x) | x.isNull())


MONTHS = {"Ianuali": 1, "Pepeluali": 2, "Malaki": 3, "Apelila": 4, "Mei": 5, "Iune": 6, "Iulai": 7, "Aukake": 8, "Kepakemapa": 9, "Okakopa": 10, "Nowemapa": 11, "Kekemapa": 12}


def parse_date(c: Column) -> Column:
    """yyyy-mm-dd (also before T), /yyyy/mm/dd/, d Month yyyy, or a year alone (its first day)."""
    f = fold(c)
    iso = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)
    url = F.regexp_extract(c, r"/(\d{4}/\d{2}/\d{2})/", 1)
    mon = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    d, m, y = (F.regexp_extract(f, r"(\d{1,2}) (?:o )?([A-Z][a-z]+),? (\d{4})", k) for k in (1, 2, 3))
    named = F.expr("null").cast("date")
    named = F.when((d != "") & F.map_contains_key(mon, m), F.make_date(y.try_cast("int"), F.try_element_at(mon, m), d.try_cast("int")))
    year = F.when(c.rlike(r"^\d{4}$"), F.make_date(c.try_cast("int"), F.lit(1), F.lit(1)))
    return F.coalesce(F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")), F.when(url != "", F.try_to_date(url, "yyyy/MM/dd")), named, year)


def entity_norm(name: Column) -> Column:
    """Small letters without okina and apostrophe, white space collapsed."""
    return F.regexp_replace(F.translate(F.lower(F.trim(name)), "ʻ'", ""), r"\s+", " ")


def entity_id(kind: Column, name: Column) -> Column:
    """TYPE_ and 24 hex digits of the sha1 of type and normalised name."""
    return F.concat(F.upper(kind), F.lit("_"), F.substring(F.sha1(F.concat(F.upper(kind), F.lit("|"), entity_norm(name))), 1, 24))


#: Entities of doubly encoded letters and what they stand for, and marks that go: fixed values, longer ones count first.
REPAIRS = {
    "&Auml;&#129;": "ā", "&Auml;&#128;": "Ā", "&Ecirc;&raquo;": "‘",
    "&Aring;&#141;": "ū", "&Auml;&ordf;": "Ī", "&Auml;&#147;": "ē",
    "&raquo;": "", "&laquo;": "", "&mdash;": "-", "&nbsp;": " ",
    "&Ecirc;": "‘", "&Aring;": "ū", "&Atilde;&#133;&Acirc;&#140;": "Ō",
    "&Atilde;&#133;&Acirc;": "ū", "&Atilde;&#132;&Acirc;": "ā",
    "&Atilde;&#138;&Acirc;&raquo;": "‘", "&Acirc;": "", "&acirc;": "",
    "&lsquo;": "'", "&rsquo;": "'", "&rdquo;": '"', "&ldquo;": '"',
    "&auml;": "ā", "&Auml;": "Ā", "&Euml;": "Ē", "&euml;": "ē",
    "&Iuml;": "Ī", "&iuml;": "ī", "&ouml;": "ō", "&Ouml;": "Ō",
    "&Uuml": "Ū", "&uuml;": "ū", "&aelig;": "‘", "&#128;&brvbar;": "-",
    "&#128;&#147;": "-", "&#128;&#148;": "-", "&#128;&#152;": "‘",
    "&#128;&#156;": '"', "&#128;&#157;": "-", "&#157;&#x9D;": "-",
    "&#128;": "", "&#129;": "", "&#140;": "Ō", "&#146;": "'",
    "&#256;": "Ā", "&#257;": "ā", "&#274;": "Ē", "&#275;": "ē",
    "&#298;": "Ī", "&#299;": "ī", "&#332;": "Ō", "&#333;": "ō",
    "&#362;": "Ū", "&#363;": "ū", "&#699;": "‘",
}
LEFTOVER = "\u0080\u00A6\u009C\u0099"


def repair_entities(c: Column) -> Column:
    """Entities of the table replaced, double quotes and control leftovers out, trimmed; other entities stay for a decoder. No replacement makes a new entity."""
    e = c
    for a, b in sorted(REPAIRS.items(), key=lambda x: -len(x[0])):
        e = F.replace(e, F.lit(a), F.lit(b))
    e = F.replace(F.regexp_replace(e, "\u0080[\u0099\u009C\u009D]", " "), F.lit('"'), F.lit(""))
    return F.trim(F.regexp_replace(e, "[" + LEFTOVER + "]", "."))


def one_okina(c: Column) -> Column:
    """Curly single quotes and apostrophes as the okina."""
    return F.translate(c, "‘’'", "ʻʻʻ")


#: Lines that end the text: fixed values.
END_MARKERS = ["applesauce", "O KA HOOMAOPOPO ANA I NA KII", "TRANSLATION OF INTRODUCTION", "After we pray", "Look up", "Share this"]
RESPLIT, LONGEST = 400, 1000


def merge_lines(lines: list[str]) -> list[str]:
    """Initials and lone capitalised words run together with the initials, words and short capitalised lines that follow."""
    starts = re.compile(r"^(?:[A-Z][a-z]*\.?(?:-[a-z, ]+)?|[A-Z]\.-?)$")
    out, i = [], 0
    while i < len(lines):
        cur = lines[i].strip()
        i += 1
        if starts.match(cur):
            while i < len(lines) and (starts.match(nxt := lines[i].strip()) or len(nxt) <= 30 and re.match("[A-Z]", nxt)):
                cur += " " + nxt
                i += 1
        out.append(cur)
    return out


def connect_lines(lines: list[str]) -> list[str]:
    """A line of an okina alone joins the line before and the one after."""
    out: list[str] = []
    open_ = False
    for x in map(str.strip, lines):
        mark = x in ("‘", "ʻ")
        if out and (mark or open_):
            out[-1] += x
        else:
            out.append(x)
        open_ = mark
    return out


def unit_lines(text: str | None) -> list[str]:
    """The lines of a page as units: merged and connected, those above ``RESPLIT`` bytes split into sentences, cut at ``LONGEST`` bytes (whole characters), up to the
    first that holds an end marker."""
    if not text:
        return []
    lines = connect_lines([x for x in merge_lines([x for x in text.split("\n") if x.strip()])])
    out = []
    for x in lines:
        parts = [p for p in re.split(r"(?<=[.?!])\s+", x) if p] if len(x.encode()) > RESPLIT else [x]
        for p in parts:
            p = p.encode()[:LONGEST].decode("utf-8", "ignore")
            if any(m in p for m in END_MARKERS):
                return out
            out.append(p)
    return out

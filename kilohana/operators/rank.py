"""Result shaping: scores, highlights, snippets, enrichment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kilohana.functions import text as T

BOILER = ["click here", "share this", "all rights reserved"]


def _boiler(c: Column) -> Column:
    e = F.lit(False)
    for p in BOILER:
        e = e | F.lower(c).contains(p)
    return e


def _len_norm(c: Column) -> Column:
    return F.least(F.octet_length(c) / 500.0, F.lit(1.0))


def _penalties(c: Column) -> Column:
    return F.when(F.octet_length(c) > 300, 0.85).otherwise(1.0) * F.when(_boiler(c), 0.8).otherwise(1.0)


def vector_sentence_score(sim: Column, quality: Column, c: Column) -> Column:
    """0.75 similarity, 0.10 quality, 0.15 length (bytes), less for long texts and boilerplate."""
    return (0.75 * sim + 0.10 * quality + 0.15 * _len_norm(c)) * _penalties(c)


def inner_hit_score(quality: Column, c: Column) -> Column:
    return (0.40 * quality + 0.60 * _len_norm(c)) * _penalties(c)


def lexical_sentence_score(ratio: Column, c: Column) -> Column:
    return ratio * _len_norm(c)


def first_per(df: DataFrame, group: str, *order) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_n_per(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def max_normalised(df: DataFrame, col: str, out: str) -> DataFrame:
    """col over its maximum; 0 where that is not positive. One row is broadcast."""
    m = df.agg(F.max(col).alias("_m"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.when(F.col("_m") > 0, F.col(col) / F.col("_m")).otherwise(0.0)).drop("_m")


def word_pattern(terms: list[str]) -> str:
    """An expression for whole words by Unicode letters."""
    return r"(?iu)(?<![\p{L}\p{M}\p{N}_])(" + "|".join(re.escape(t) for t in terms) + r")(?![\p{L}\p{M}\p{N}_])"


def highlight(c: Column, terms: list[str], start: str = "<mark>", end: str = "</mark>") -> Column:
    return F.regexp_replace(c, word_pattern(terms), f"{start}$1{end}") if terms else c


_VOWEL = {"a": "[aĀā]", "e": "[eĒē]", "i": "[iĪī]", "o": "[oŌō]", "u": "[uŪū]"}


def loose_pattern(term: str) -> str:
    """A term as an expression that allows okina marks before letters and macrons on vowels."""
    out = []
    for ch in term.translate(str.maketrans(T.MACRON, T.PLAIN, T.OKINA)):
        low = ch.lower()
        out.append("[ʻ‘]*" + _VOWEL[low] if low in _VOWEL else re.escape(ch))
    return "(?i)(" + "".join(out) + ")"


def highlight_loose(c: Column, term: str) -> Column:
    return F.regexp_replace(c, loose_pattern(term), '<span class="match">$1</span>')


def regex_terms(expr: str) -> list[str]:
    """Words of three letters or more that an expression holds, each once."""
    plain = re.sub(r"\\[a-zA-Z]|[\\^$.|?*+()\[\]{}]", " ", expr)
    return list(dict.fromkeys(w for w in re.findall(r"[^\W\d_ʻ](?:[^\W\d_]|ʻ)*", plain) if len(w) >= 3))


def regex_terms_column(c: Column) -> Column:
    """regex_terms over a column of expressions."""
    plain = F.regexp_replace(c, r"\\[a-zA-Z]|[\\^$.|?*+()\[\]{}]", " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(plain, F.lit(r"\p{L}[\p{L}ʻ]*"), F.lit(0)), lambda x: F.length(x) >= 3))


def snippet(c: Column, term: str, before: int = 200, size: int = 500) -> Column:
    """The text around the term's first place, with ellipses where it is cut."""
    pos = F.locate(term.lower(), F.lower(c))
    start = F.greatest(pos - 1 - before, F.lit(0))
    cut = F.substring(c, start + 1, F.lit(size))
    around = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(start + size < F.length(c), "...").otherwise(""))
    return F.when(pos > 0, around).otherwise(F.concat(F.substring(c, 1, size), F.when(F.length(c) > size, "...").otherwise("")))


def token_hits(c: Column, term: str) -> Column:
    return F.regexp_count(c, F.lit(word_pattern([term])))

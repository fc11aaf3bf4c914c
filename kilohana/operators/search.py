"""Sentence and document search: one lazy plan per query, whatever the mode.

The stores that the reference queries give one mode name several meanings; ``dialect`` picks one (``elastic`` by default, ``mysql``, ``postgres``). Every
mode is a predicate over a column or its token array, so filters, sorting and paging stay in one plan, and a count is the count of the unpaged plan. Relevance
is BM25 (k1 1.2, b 0.75) over the postings of the query's words only: documents without them never leave the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohana.functions import text as T

#: Modes by level. The first is the default of the level.
SENTENCE_MODES = ["match", "matchall", "phrase", "term", "regexp", "wildcard"]
STORE_MODES = {"mysql": ["exact", "any", "all", "regex"], "postgres": ["any", "all", "exact", "near", "regex", "hybrid"]}
VECTOR_MODES = ["vector", "knn", "hybrid"]
#: Names of before and the mode they mean now.
LEGACY = {"matchsentence": "match", "matchsentence_all": "matchall", "phrasesentence": "phrase", "termsentence": "term", "regexpsentence": "regexp", "wildcardsentence": "wildcard", "exact": "phrase", "any": "match", "all": "matchall", "regex": "regexp", "near": "phrase"}
K1, B = 1.2, 0.75


def mode_of(name: str) -> str:
    """The mode that a name means; unknown names mean match."""
    return name if name in SENTENCE_MODES + VECTOR_MODES else LEGACY.get(name, "match")


def tokens(c: Column, folded: bool = False) -> Column:
    """Lower-case runs of letters and digits; folded: okina and macrons off first."""
    return F.filter(F.split(F.lower(T.fold(c) if folded else c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_tokens(term: str, folded: bool = False) -> list[str]:
    if folded:
        term = term.translate(str.maketrans(T.MACRON, T.PLAIN, T.OKINA))
    return [t for t in re.split(r"[^\w]+|_", term.lower()) if t]


def guarded(term: str | None) -> str:
    """A term without white space and quotes around it; '' where nothing is left."""
    return (term or "").strip().strip('"“”').strip()


def _has(part: str):
    return lambda x: x.contains(part)


def _is(word: str):
    return lambda x: x == word


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def predicate(c: Column, mode: str, term: str, folded: bool = False, dialect: str = "elastic") -> Column:
    """Whether a text matches."""
    if not term or not term.strip():
        return F.lit(False)
    if dialect == "mysql":
        col, t = (T.fold(c), term.translate(str.maketrans(T.MACRON, T.PLAIN, T.OKINA))) if folded else (c, term)
        if mode == "exact":
            return F.lower(col).contains(t.lower())
        if mode == "regex":
            return col.rlike("(?iu)" + t.replace("[[:<:]]", r"\b").replace("[[:>:]]", r"\b"))
        words = [w.lower() for w in re.split(r"[\s,?!.;:()]+", t) if w]
        return F.arrays_overlap(tokens(col), _array(words)) if mode == "any" else F.size(F.array_intersect(tokens(col), _array(words))) == len(set(words))
    if dialect == "postgres":
        mode = {"any": "match", "all": "matchall"}.get(mode, "phrase")
    mode = mode_of(mode)
    if mode == "regexp":
        return c.rlike(f"(?i)^(?:{term})$")
    if mode == "wildcard":
        parts = [p.lower() for p in term.split("*") if p]
        if not parts:
            return F.lit(False)
        toks = tokens(c, folded)
        e = None
        for p in parts:
            one = F.exists(toks, _has(p))
            e = one if e is None else e & one
        return e
    if mode == "term":
        return F.array_contains(tokens(c, True), term) if folded else F.array_contains(tokens(c), term)
    words = query_tokens(term, folded)
    if not words:
        return F.lit(False)
    if mode == "matchall":
        return F.size(F.array_intersect(tokens(c, folded), _array(words))) == len(set(words))
    if mode == "phrase":
        return F.concat(F.lit(" "), F.array_join(tokens(c, folded), " "), F.lit(" ")).contains(" " + " ".join(words) + " ")
    return F.arrays_overlap(tokens(c, folded), _array(words))


def search(rows: DataFrame, mode: str, term: str, text: str = "hawaiiantext", folded: bool = False, dialect: str = "elastic") -> DataFrame:
    """The rows that match."""
    return rows.where(predicate(F.col(text), mode, term, folded, dialect))


def count(rows: DataFrame, mode: str, term: str, text: str = "hawaiiantext", folded: bool = False, dialect: str = "elastic") -> DataFrame:
    """(n): matching rows; -1 for modes that rank everything, all rows for an empty term. The plan holds no join and no sort."""
    if mode_of(mode) in VECTOR_MODES and mode not in STORE_MODES["postgres"][:5]:
        return rows.limit(1).agg(F.lit(-1).cast("long").alias("n"))
    return (search(rows, mode, term, text, folded, dialect) if term and term.strip() else rows).agg(F.count("*").alias("n"))


def bm25(rows: DataFrame, key: str, term: str, text: str = "hawaiiantext", folded: bool = False, all_words: bool = False, ratio: Column | None = None) -> DataFrame:
    """(key, score): BM25 over the words of the query; ``ratio`` multiplies by ln(1+ratio).

    Corpus size, mean length and document frequencies come from one aggregate over all rows; it is one row and joins by broadcast.
    """
    words = sorted(set(query_tokens(term, folded)))
    low = F.lower(T.fold(F.col(text)) if folded else F.col(text))
    toks = tokens(F.col(text), folded)
    size = F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+"))
    # A text is cut into words only where the letters of a query word stand in it.
    has = [low.contains(w) & F.array_contains(toks, w) for w in words]
    stats = rows.select(size.alias("len"), *[h.alias(f"h{i}") for i, h in enumerate(has)])
    stats = stats.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"h{i}")).alias(f"df{i}") for i in range(len(words))])
    near = None
    for w in words:
        one = low.contains(w)
        near = one if near is None else (near & one if all_words else near | one)
    d = rows.where(near if near is not None else F.lit(False)).select(key, size.alias("len"), toks.alias("t"), *([ratio.alias("_ratio")] if ratio is not None else []))
    d = d.select("*", *[F.size(F.filter(F.col("t"), _is(w))).alias(f"tf{i}") for i, w in enumerate(words)])
    hit = None
    for i in range(len(words)):
        one = F.col(f"tf{i}") > 0
        hit = one if hit is None else (hit & one if all_words else hit | one)
    j = d.where(hit if hit is not None else F.lit(False)).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(words)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    if ratio is not None:
        score = score * F.log1p(F.coalesce(F.col("_ratio"), F.lit(1.0)))
    return j.select(key, F.round(score, 6).alias("score"))

"""Problem 3: lines repeated across one group's sources.

Lines are normalised (case, spacing, punctuation, brackets, numbers and dates away), hashed, and counted by the distinct sources of their group that
hold them; a line in at least ``min_sources`` sources and ``min_share`` of the group's sources is frequent and leaves the documents. Everything is
grouped by (group, hash) after a distinct on (group, hash, source), so a source that holds a third of all rows is folded before it is counted; joins on a
source or a line are salted, and documents are rebuilt in parts of bounded size.

Null lines, lines without letters and sources without a group never count. Equal lines in one source count once. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohana.session import cut_lineage

from .base import CONFUSABLE, INVISIBLE, OKINA_MARKS, SPACES, WIDE, latest

MONTHS = (
    "ianuali|pepeluali|malaki|apelila|aperila|mei|iune|iulai|aukake|augate|kepakemapa|sepatemaba|okakopa|okatopa|nowemapa|novemaba|kekemapa|dekemaba"
    "|january|february|march|april|may|june|july|august|september|october|november|december"
)
#: Tasks over which a hot source or line is spread, and ids in one part of a rebuilt document.
SALTS, PART = 8, 4096
#: A date: a month's name beside a number.
DATE = rf"(?:\d+\s*(?:o\s+)?(?:{MONTHS})\b[\s,]*\d*|\b(?:{MONTHS})\s*\d+(?:\s*,?\s*\d+)?)"


def line_key(c: Column) -> Column:
    """The line as it is compared; '' when it has no letters."""
    drop = INVISIBLE + OKINA_MARKS + "ʻ"
    pairs = {**WIDE, **CONFUSABLE, **{s: " " for s in SPACES}}
    pairs = {k: v for k, v in pairs.items() if k not in drop}
    folded = F.lower(F.translate(c, "".join(pairs) + drop, "".join(pairs.values())))
    has_digit = F.when(folded.rlike(r"\d"), F.regexp_replace(folded, DATE, " ")).otherwise(folded)
    return F.regexp_replace(has_digit, r"[^\p{L}\p{M}]+", "")


def _salted(small: DataFrame) -> DataFrame:
    """Each row once for every salt, so that a hot key of the other side is met in ``SALTS`` tasks."""
    return small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def _salt(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")


def last_rows(sentences: DataFrame, *cols: str) -> DataFrame:
    """(sentenceid, _src, _x, cols...), one per id: the row delivered last; of equal times the largest source, then the largest hash of the line."""
    s = F.struct(F.col("created").isNotNull().alias("k"), "created", F.col("sourceid").alias("_src"), F.xxhash64("hawaiiantext").alias("_x"), *cols)
    return sentences.where(F.col("sentenceid").isNotNull()).groupBy("sentenceid").agg(F.max(s).alias("_s")).select("sentenceid", "_s._src", "_s._x", *[f"_s.{c}" for c in cols])


def keyed_lines(sentences: DataFrame, sources: DataFrame) -> DataFrame:
    """(sentenceid, _src, _grp, _h): each row's source, its group, and the hash of its compared line, null where the line never counts.

    Lines are hashed before anything moves, so no shuffle carries a text.
    """
    key = line_key(F.col("hawaiiantext"))
    h = F.when(key != "", F.xxhash64(key, F.length(key)))
    rows = last_rows(sentences.withColumn("_h", h), "_h").where("_src IS NOT NULL").withColumn("_salt", _salt("sentenceid"))
    groups = latest(sources.where(F.col("groupname").isNotNull()), "sourceid", "groupname").where(F.trim("groupname") != "")
    g = _salted(groups.select(F.col("sourceid").alias("_src"), F.col("groupname").alias("_grp")))
    return rows.join(g, ["_src", "_salt"]).select("sentenceid", "_src", "_grp", "_h")


def frequent(keyed: DataFrame, min_sources: int = 5, min_share: float = 0.2) -> DataFrame:
    """(_grp, _h, n_sources): the lines that stand in at least ``min_sources`` sources and ``min_share`` of the group's sources that have rows."""
    n = keyed.where("_h IS NOT NULL").select("_grp", "_h", "_src").distinct().groupBy("_grp", "_h").agg(F.count("*").alias("n_sources")).where(F.col("n_sources") >= min_sources)
    all_ = keyed.select("_grp", "_src").distinct().groupBy("_grp").agg(F.count("*").alias("n_all"))
    return n.join(all_, "_grp").where(F.col("n_sources") >= min_share * F.col("n_all")).select("_grp", "_h", "n_sources")


def found(sentences: DataFrame, sources: DataFrame, min_sources: int = 5, min_share: float = 0.2) -> DataFrame:
    """p3_found: the sentence rows whose line is frequent in their group."""
    keyed = cut_lineage(keyed_lines(sentences, sources))
    f = _salted(frequent(keyed, min_sources, min_share).select("_grp", "_h"))
    return keyed.where("_h IS NOT NULL").withColumn("_salt", _salt("sentenceid")).join(f, ["_grp", "_h", "_salt"], "left_semi").select("sentenceid")


def cleaned(sentences: DataFrame, sources: DataFrame, min_sources: int = 5, min_share: float = 0.2) -> DataFrame:
    """Each source's text rebuilt without the frequent lines, in parts: (sourceid, part, n_kept, n_removed, text).

    A part holds the rows of one block of ``PART`` ids, so the size of a part is bounded whatever the source's; a source's parts in order of their numbers,
    and the lines in them in order of their ids, are its text. A part whose lines are all gone has an empty text.
    """
    rows = last_rows(sentences, "hawaiiantext").withColumnRenamed("_src", "sourceid")
    gone = found(sentences, sources, min_sources, min_share).withColumn("_gone", F.lit(1))
    j = rows.join(gone, "sentenceid", "left")
    kept = F.when(F.col("_gone").isNull(), F.struct("sentenceid", "hawaiiantext"))
    return j.groupBy("sourceid", F.floor(F.col("sentenceid") / PART).alias("part")).agg(
        F.count(F.when(F.col("_gone").isNull(), 1)).alias("n_kept"),
        F.count("_gone").alias("n_removed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["hawaiiantext"]), "\n").alias("text"),
    )

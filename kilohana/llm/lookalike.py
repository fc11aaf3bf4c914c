"""Problem 4: text that looks the same but is stored with other characters.

Look-alike letters, wide and narrow forms, special spaces, invisible characters and the marks for the okina are mapped in SQL; the mapped values are
grouped under the accent- and case-sensitive Unicode collation, which also takes composed and combining accents as one. A class that holds more than
one stored text gets a canonical member, the one with the fewest mapped characters, then the least in code point order, and all its rows are joined to it.

A hash of the mapped letters without any mark narrows the rows that are collated; it is equal wherever texts are canonically equal. Spark's collation takes
two marks on one letter in another order as different, so that case stays apart.

Null texts stand in no class. Repeated rows of one id count once. Another case, a lost macron or a lost okina make another class.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilohana.session import cut_lineage

from .base import CONFUSABLE, INVISIBLE, OKINA_MARKS, SPACES, WIDE

_OKINA = "ʻ"
#: Half-width kana and their marks; the voicing marks become combining ones.
_HALF = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF61, 0xFFA0)}


def _composed() -> tuple[dict[str, str], dict[str, str]]:
    """Composed letters whose base letter is a look-alike, and what they show: one character, or a letter with marks."""
    one, more = {}, {}
    for c in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(c))
        if d != chr(c) and d[0] in CONFUSABLE:
            to = unicodedata.normalize("NFC", CONFUSABLE[d[0]] + d[1:])
            (one if len(to) == 1 else more)[chr(c)] = to
    return one, more


_COMPOSED, _COMPOSED_MORE = _composed()
#: Characters that are another one by their canonical form.
_SINGLE = {chr(c): n for c in [*range(0xA0, 0xAC00), *range(0xF900, 0x30000)] if len(n := unicodedata.normalize("NFC", chr(c))) == 1 and n != chr(c)}
_PAIRS = {**_SINGLE, **WIDE, **_HALF, **CONFUSABLE, **_COMPOSED, **{s: " " for s in SPACES}, **{o: _OKINA for o in OKINA_MARKS}}
#: Vowels and the macron forms they compose to.
_MACRON = dict(zip("aeiouAEIOU", "āēīōūĀĒĪŌŪ"))
#: Voiced kana by their parts.
_VOICED = {unicodedata.normalize("NFD", chr(c)): chr(c) for c in range(0x3041, 0x30FF) if len(unicodedata.normalize("NFD", chr(c))) == 2}


def _bases() -> dict[str, str]:
    """Every composed character (but Hangul syllables) and the base letter of its canonical decomposition."""
    out = {}
    for c in [*range(0xA0, 0xAC00), *range(0xF900, 0x30000)]:
        d = unicodedata.normalize("NFD", chr(c))
        if d != chr(c) and all(unicodedata.category(x)[0] == "M" for x in d[1:]):
            out[chr(c)] = d[0]
    return out


_BASES = _bases()


#: What the skeleton leaves out: marks, what shows nothing, and Hangul, whose syllables equal sequences of parts.
UNSEEN = r"[\p{M}\p{Cc}\p{Cf}\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}]+"


def mapped(c: Column) -> Column:
    """Every look-alike replaced; combining marks stay for the collation to settle."""
    e = F.translate(c, "".join(_PAIRS) + INVISIBLE, "".join(_PAIRS.values()))
    spread = e
    for a, b in _COMPOSED_MORE.items():
        spread = F.replace(spread, F.lit(a), F.lit(b))
    return F.when(c.rlike("[" + "".join(_COMPOSED_MORE) + "]"), spread).otherwise(e)


def one_form(c: Column) -> Column:
    """The single stored form: mapped, and macrons composed."""
    e = mapped(c)
    for a, b in {**{a + "̄": b for a, b in _MACRON.items()}, **_VOICED}.items():
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def simplify(c: Column) -> Column:
    """The reference fold: macron vowels plain, okina away; case kept."""
    return F.translate(c, "ōīēūāŌĪĒŪĀ‘ʻ", "oieuaOIEUA")


def skeleton(c: Column) -> Column:
    """A hash of the mapped letters without their marks: equal for all canonically equal texts, so it narrows the rows that are collated and loses no pair.

    It also keeps apart what the collation equates though it looks different: digits of other scripts, styled and enclosed letters.
    """
    return F.xxhash64(F.regexp_replace(F.translate(mapped(c), "".join(_BASES), "".join(_BASES.values())), UNSEEN, ""))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_key", F.collate(mapped(F.col("hawaiiantext")), "UNICODE"))


def _last(hashed: DataFrame, *cols: str) -> DataFrame:
    """One row per sentenceid, the last delivered; of equal times the one with the largest hash of its text, of those the largest text."""
    s = F.struct(F.col("created").isNotNull().alias("k"), "created", "_x", *cols)
    return hashed.groupBy("sentenceid").agg(F.max(s).alias("s")).select("sentenceid", "s._x", *[f"s.{c}" for c in cols])


def _hashed(sentences: DataFrame) -> DataFrame:
    t = F.col("hawaiiantext")
    return sentences.where(t.isNotNull() & F.col("sentenceid").isNotNull()).withColumn("_x", F.xxhash64(t))


def candidates(sentences: DataFrame) -> DataFrame:
    """(sentenceid, hawaiiantext, _h), one per id: the rows whose skeleton comes with more than one stored text.

    Ids are told apart and skeletons counted on hashes alone; only the candidates' texts move.
    """
    rows = _hashed(sentences)
    light = _last(rows.select("sentenceid", "created", "_x", skeleton(F.col("hawaiiantext")).alias("_h")), "_h")
    many = light.groupBy("_h").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_lo <> _hi").select("_h")
    ids = light.join(many, "_h", "left_semi").select("sentenceid", "_x", "_h")
    return rows.select("sentenceid", "hawaiiantext", "_x").join(ids, ["sentenceid", "_x"]).select("sentenceid", "hawaiiantext", "_h").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(_key, _h, canonical): the classes that hold more than one stored text, with the canonical member's one form.

    rows: (sentenceid, hawaiiantext, _h), one per id.
    """
    t = F.col("hawaiiantext")
    odd = F.length(t) - F.length(F.translate(t, "".join(_PAIRS) + INVISIBLE + "\u0304", ""))
    return (
        _keyed(rows)
        .withColumn("_odd", odd)
        .groupBy("_key", "_h")
        .agg(F.min("hawaiiantext").alias("_lo"), F.max("hawaiiantext").alias("_hi"), F.min(F.struct("_odd", "hawaiiantext")).alias("_m"))
        .where("_lo <> _hi")
        .select("_key", "_h", one_form(F.col("_m.hawaiiantext")).alias("canonical"))
    )


def members(sentences: DataFrame) -> DataFrame:
    """(sentenceid, hawaiiantext, class_id, canonical) of every row in a class of more than one stored text."""
    c = cut_lineage(candidates(sentences))
    k = classes(c).withColumn("class_id", F.xxhash64("canonical"))
    return _keyed(c).join(k, ["_key", "_h"]).select("sentenceid", "hawaiiantext", "class_id", "canonical")


def found(sentences: DataFrame) -> DataFrame:
    """p4_found: pairs of ids that look the same and differ in their characters, the smaller id first.

    Stored texts of a class are paired first, then their rows joined to them, so rows of one text are never compared with each other.
    """
    m = cut_lineage(members(sentences))
    forms = m.groupBy("class_id", "canonical", "hawaiiantext").agg(F.count("*").alias("_n"))
    a = forms.select("class_id", "canonical", F.col("hawaiiantext").alias("_ta"))
    b = forms.select("class_id", "canonical", F.col("hawaiiantext").alias("_tb"))
    two = a.join(b, ["class_id", "canonical"]).where("_ta < _tb")
    x = m.select("class_id", F.col("hawaiiantext").alias("_ta"), F.col("sentenceid").alias("_ia"))
    y = m.select("class_id", F.col("hawaiiantext").alias("_tb"), F.col("sentenceid").alias("_ib"))
    j = two.join(x, ["class_id", "_ta"]).join(y, ["class_id", "_tb"])
    return j.select(F.least("_ia", "_ib").alias("sentenceid_a"), F.greatest("_ia", "_ib").alias("sentenceid_b"))


def one_text(sentences: DataFrame) -> DataFrame:
    """Every sentence in one form: (sentenceid, hawaiiantext, simplified, changed)."""
    rows = _last(_hashed(sentences).select("sentenceid", "created", "_x", "hawaiiantext"), "hawaiiantext")
    j = rows.join(members(sentences).select("sentenceid", "canonical"), "sentenceid", "left")
    out = F.coalesce("canonical", one_form(F.col("hawaiiantext")))
    return j.select("sentenceid", out.alias("_t"), (out != F.col("hawaiiantext")).alias("changed")).select("sentenceid", F.col("_t").alias("hawaiiantext"), simplify(F.col("_t")).alias("simplified"), "changed")

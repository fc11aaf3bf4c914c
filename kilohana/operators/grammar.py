"""Grammar rules over sentences: pattern scan, fingerprint, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (pattern type, signature, expression): fixed values of the sentence patterns that queries name.
RULES = [
    ("pepeke_aike_he", "HE + KIKINO", r"""^He\s+[\wāēīōūʻ]+\s+"""),
    ("pepeke_aike_o", "O + NAME", r"""^ʻ?O\s+[\wāēīōūʻ]+\s+[\wāēīōūʻ]+"""),
    ("kalele_kulana", "PREP_FRONTING + AI", r"""^(Ma|I|No|Ma muli o)\s+[^.,?!;:\"]*?\s+ai[\s,.]"""),
    ("pepeke_henua", "AIA + LOCATIVE", r"""\b[aA]ia\s+"""),
    ("kalele_akena", "NA + ACTOR + I + VERB", r"""^Na\s+[\wāēīōūʻ]+\s+i\s+"""),
    ("hiki_infinitive", "HIKI + KE", r"""^Hiki\s+[^.,?!;:\"]*?\s+ke\s+[\wāēīōūʻ]+"""),
    ("hoole_pepeke", "AAOLE (NEGATIVE)", r"""^ʻ?Aʻ?ole\s+"""),
    ("pepeke_painu_ana", "E + VERB + ANA (FUTURE/CONT)", r"""^E\s+.*?\s+ana"""),
    ("dir_la_no_ia", "DIRECTIONAL + LA NO IA", r"""[\s,](mai|aku|iho|aʻ?e)\s*la\s+n[oō]\s+ia"""),
    ("pepeke_painu", "TENSE + VERB", r"""^(Ua|E|Ke|I)\s+[\wāēīōūʻ]+"""),
    ("hoole_pepeke_painu", "AAOLE + I/E", r"""^ʻ?Aʻ?ole\s+(i|e)\s+"""),
    ("hoole_pepeke_aike_o", "AAOLE + O", r"""^ʻ?Aʻ?ole\s+ʻ?o\s+"""),
    ("hoole_pepeke_aike_he", "AAOLE + HE", r"""^ʻ?Aʻ?ole\s+he\s+"""),
    ("hoole_kalele_akena", "AAOLE + NA", r"""^ʻ?Aʻ?ole\s+na\s+"""),
    ("aohe_existential", "AOHE (EXISTENTIAL NEG)", r"""^ʻ?Aʻ?ohe\s+"""),
    ("kalele_kumua", "MAI + ... + MAI", r"""^Mai\s+.*?\s+mai"""),
    ("o_ka_v_dir_la", "O KA VERB DIR LA NO IA", r"""^ʻ?O\s+(ka|ke)\s+[^.,?!;:\"]*?\s+(ala|mai|aku|iho|aʻ?e)\s*la\s+n[oō]\s+ia"""),
    ("i_loko_no_o", "I LOKO NO O", r"""^I\s+loko\s+n[oō]\s+o\s+"""),
    ("pepeke_oi_aku", "OI AKU", r"""^ʻ?Oi\s+aku\s+"""),
    ("pepeke_e_aho", "E AHO", r"""^E\s+aho\s+"""),
    ("i_mea_e_painu_ai", "I MEA E ... AI", r"""^I\s+mea\s+e\s+.*?\s+ai\b"""),
    ("ma_ke_ano_he", "MA KE ANO HE", r"""\bma\s+ke\s+ʻ?ano\s+he\b"""),
    ("pepeke_nonoa", "HE ... KO/KA", r"""^He\s+.*?\s+(k[oō]|k[aā]|[oō]|[aā])\s+"""),
]
#: Marker words of the fingerprint, fixed values; the ones of several words are looked for first and used up.
MULTI = ["i ka", "i ke", "ma ka", "ma ke", "e ana", "ua pau"]
MARKERS = ["he", "o", "ma", "i", "no", "na", "ai", "ana", "ua", "ke", "aia", "aole", "hiki", "nei", "ala", "mai", "aku", "iho", "ae"]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, "(?iuU)" + c, b) for a, b, c in RULES], "pattern_type string, regex string, signature string")


def fingerprint(c: Column) -> Column:
    """Markers joined by hyphens; plain without any. A marker of several words counts once, wherever its letters stand."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{M}\p{N}_\sʻ]", "")
    found, rest = [], s
    for m in MULTI:
        found.append(F.when(rest.contains(m), F.lit(m.replace(" ", "_"))))
        rest = F.replace(rest, F.lit(m), F.lit(" "))
    single = F.filter(F.regexp_extract_all(rest, F.lit(r"([\p{L}\p{M}\p{N}_]+)")), lambda x: x.isin(MARKERS))
    out = F.array_join(F.concat(F.array_compact(F.array(*found)), single), "-")
    return F.when(out == "", "plain").otherwise(out)


def types(c: Column) -> Column:
    """The array of pattern types that a text shows."""
    return F.array_compact(F.array(*[F.when(c.rlike("(?iuU)" + rx), F.lit(t)) for t, _, rx in RULES]))


def scan(sentences: DataFrame) -> DataFrame:
    """(sentenceid, sourceid, pattern_type, signature): a row per sentence and rule that matches; no join, one pass."""
    hit = F.filter(
        F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.col("hawaiiantext").rlike("(?iuU)" + rx).alias("ok")) for t, s, rx in RULES]),
        lambda x: x["ok"],
    )
    x = sentences.select("sentenceid", "sourceid", fingerprint(F.col("hawaiiantext")).alias("fp"), F.explode(hit).alias("p"))
    return x.select("sentenceid", "sourceid", F.col("p.t").alias("pattern_type"), F.concat_ws(" | ", "p.s", "fp").alias("signature"))

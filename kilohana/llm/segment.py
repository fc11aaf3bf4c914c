"""Problem 1: sentence boundaries by cascading segmentation rule tables.

A rule is a pair of regular expressions, what stands before a position and what stands after it, with a verdict: break or no break. The tables
of a record's language come first, those of the other languages next, the common one last; the first rule that matches a candidate position
decides it. Candidates are the positions behind a run of sentence-final marks and the closing quotes and brackets that follow it. A line break
always ends a unit. Positions count code points from 1.

Nulls and texts without letters have no units; an empty table gives an empty result; repeated rows of one id count once, the last delivered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import LANG_NAMES, OKINA_MARKS, canon_lang, latest, map_rows

# Pieces of the expressions. OK: an okina in any of its marks. UP: what a new sentence can begin with.
OK = "[ʻ" + re.escape(OKINA_MARKS) + "]"
ZW = r"[\s­​-‏⁠﻿]"
OPEN = "[“‘\"'«‹(（\\[［{「『【〈《¿¡—–-]"
CLOSE = "[”’\"»›)）\\]］}」』】〉》]"
CJK = r"[぀-ヿ㐀-鿿ｦ-ﾟ]"
FINAL = r"[.!?…。！？．｡]"
#: Sentence-final runs with their closers; the closers go with the sentence.
CANDIDATE = re.compile(rf"{FINAL}+[​-‍⁠﻿]*(?:{CLOSE}+{FINAL}*)*")

Rule = tuple[bool, str, str]  # (break here?, before, after)

#: Rules of each language, then the common ones under "". In order: the first pair that matches decides.
RULES: dict[str, list[Rule]] = {
    "haw": [
        (False, r"\b(?:Rev|Hon|Kauka|Lk|Kap|Kapena|Mok|Helu)\.", r"\s"),
    ],
    "en": [
        (False, r"\b(?:Mr|Mrs|Ms|Messrs|Mmes|Dr|Rev|Hon|Prof|St|Ste|Mt|Ft|Capt|Col|Gen|Lt|Sgt|Gov|Sen|Rep|Pres|Supt|Jr|Sr|Esq|Bros)\.", rf"{ZW}+[^\W\d_a-z]"),
        (False, r"\b(?:MR|MRS|MS|DR|REV|HON|PROF|ST|CAPT|COL|GEN|LT|GOV|JR|SR)\.", rf"{ZW}+[A-ZĀ-ſʻ]"),
        (False, r"\b(?:vs|viz|cf|e\.g|i\.e|al|ca|approx|dept|est)\.", rf"{ZW}"),
    ],
    "pt": [
        (False, r"\b(?:Sr|Sra|Srs|Sras|Srta|D|Dr|Dra|Drs|Prof|Profa|Eng|Exmo|Exma|Sto|Sta|Pe|Av|R)\.", rf"{ZW}+[^\W\d_a-z]"),
        (False, r"\b(?:pág|págs|núm|n|vol|cap|tel)\.", rf"{ZW}*\d"),
    ],
    "mi": [(False, r"\b(?:Tā|Rev|Rt)\.", rf"{ZW}+[^\W\d_a-z]")],
    "sm": [(False, r"\b(?:Susuga|Afioga|Rev)\.", rf"{ZW}+[^\W\d_a-z]")],
    "ja": [
        (False, r"[。．！？!?…｡]+[」』）】]+", r"(?:と|って|とか|という|なんて|の(?!そ)|を|は|が|も|に)(?=" + CJK + r"|[、，,])"),
        (False, r"[。．！？!?…｡]+[」』）】]+", "[、，,。]"),
    ],
    "zh": [
        (False, r"[。．！？!?…｡]+[」』）】”]+", r"[^。！？!?「」『』\n]{0,10}?(?:說|说|道|問|问|喊|叫|答|寫|写)(?:[。，,：:！？!?了着著道]|$)"),
        (False, r"[。．！？!?…｡]+[」』）】”]+", "[，,、。]"),
    ],
    "": [
        # Nothing may begin here: the run is followed by more of the same sentence.
        (False, "", rf"{ZW}*[,;:，、；：]"),
        (False, r"[(（\[]\s{0,8}[!?…]+\s{0,8}[)）\]]", ""),
        (False, "", rf"{ZW}*{OK}?[a-zāēīōūàáâãéêíóôõúç]"),
        # Numbered parts, sections, pages, sums: an abbreviation and its number.
        (False, r"(?<!m\. )\b(?:[Nn]o|NO|[Nn]os|[Vv]ol|VOL|[Vv]ols|[Pp]p?|PP?|[Ff]ig|FIG|[Ss]ec|[Cc]h|[Cc]hap|[Aa]rt|[Hh]elu|[Mm]ok|[Pp]au)\.", rf"{ZW}*[\d#]"),
        (False, r"\d\.", r"\d"),
        # Titles, and names that begin with an abbreviation.
        (False, r"\b(?:Mr|Mrs|Ms|Dr|Rev|Hon|Prof|St|Sr|Sra|Capt|Col|Gen|Lt|Jr)\.", rf"{ZW}+{OK}?[A-ZĀĒĪŌŪ]"),
        (False, r"\b(?:etc|&c|cf|viz)\.", rf"{ZW}*[a-z,;)]"),
        (False, r"&\s?Co\.", rf"{ZW}+[a-z]"),
        (True, r"\d\s?[AP]\.M\.", rf"{ZW}+{OPEN}?{OK}?[A-ZĀĒĪŌŪ]"),
        # Initials: one capital letter that stands alone.
        (False, rf"(?:^|[\s(“\"‘'.])[A-ZĀĒĪŌŪ]\.", rf"{ZW}*{OK}?[A-ZĀĒĪŌŪ]"),
        # What is left breaks: before a space, at the end of a line, or without a space before a capital, a quotation or a bracket.
        (True, "", rf"{ZW}+(?:{OPEN}|{OK})*[^\W_]"),
        (True, "", r"\s*\n"),
        (True, "", rf"{CJK}|[「『（“]"),
        (True, r"[。！？．｡][”’\"»)）\]」』】]*", r"\S"),
        (True, r"[^\W\d_][.!?…]+[”’\"»)\]」』】]*", rf"{OPEN}?{OK}?[A-ZĀĒĪŌŪ]"),
        (True, r"[!?][”’\"»)\]」』】]*", rf"{OPEN}?\w"),
        (True, r"[)\d][.!?…]+[”’\"»)\]」』】]*", rf"{OPEN}?{OK}?[A-ZĀĒĪŌŪ]"),
        (True, "", rf"{ZW}+\S"),
        (False, "", ""),
    ],
}


def cascade(lang: str | None) -> list[Rule]:
    """The rules in force for a language: its own table, those of the others, the common one."""
    own = [r for r in RULES.get(lang or "", []) if lang]
    rest = [r for k in LANG_NAMES for r in RULES[k] if k != lang]
    return own + rest + RULES[""]


def compile_rules(rules: list[Rule]) -> list[tuple[bool, re.Pattern | None, re.Pattern | None]]:
    """Compile in order; neighbours of one verdict and one after-part become one alternation, which decides alike."""
    out: list[tuple[bool, list[str], str]] = []
    for brk, before, after in rules:
        if out and before and out[-1][0] == brk and out[-1][2] == after and out[-1][1] != [""]:
            out[-1][1].append(before)
        else:
            out.append((brk, [before], after))
    return [(b, re.compile("(?:" + "|".join(f"(?:{x})" for x in be) + r")\Z") if be != [""] else None, re.compile(af) if af else None) for b, be, af in out]


class Segmenter:
    """Cuts texts into sentence units; rule tables are compiled once per language."""

    #: Characters before a run of final marks that before-parts are shown. It cuts nothing: no rule reaches farther, the run itself is always whole.
    LOOK_BACK = 24

    def __init__(self) -> None:
        self._by_lang: dict[str | None, list] = {}

    def _rules(self, lang: str | None) -> list:
        if lang not in self._by_lang:
            self._by_lang[lang] = compile_rules(cascade(lang))
        return self._by_lang[lang]

    def ends(self, text: str | None, lang: str | None = None) -> list[int]:
        """1-based positions of the last character of each unit but the last."""
        if not text:
            return []
        rules, ends, n = self._rules(lang), [], len(text)
        back = self.LOOK_BACK
        start = 0
        while start < n:
            stop = text.find("\n", start)
            stop = n if stop < 0 else stop
            line_end = stop
            while line_end > start and (text[line_end - 1].isspace() or text[line_end - 1] in "​‌‍⁠﻿­"):
                line_end -= 1
            if line_end > start:
                for m in CANDIDATE.finditer(text, start, line_end):
                    e = m.end()
                    if e >= line_end:
                        break
                    lo = max(start, m.start() - back)
                    for brk, before, after in rules:
                        if after is not None and not after.match(text, e, stop):
                            continue
                        if before is not None and not before.search(text, lo, e):
                            continue
                        if brk:
                            ends.append(e)
                        break
                ends.append(line_end)
            start = stop + 1
        return ends[:-1]

    def units(self, text: str | None, lang: str | None = None) -> list[tuple[int, int, str]]:
        """(first, last, unit) of each sentence, 1-based, without the white space around it."""
        if not text:
            return []
        out, a = [], 0
        stripped = text.rstrip()
        for e in [*self.ends(text, lang), len(stripped)]:
            s = text[a:e]
            u = s.strip()
            if u:
                first = a + len(s) - len(s.lstrip()) + 1
                out.append((first, first + len(u) - 1, u))
            a = e
        return out


def sentence_ends(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, extra..., ends array<int>) of each row; null text has no ends."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    cols = [id_col, text_col, *( [lang_col] if lang_col else []), *extra]
    k = len(cols) - len(extra)

    def make():
        seg = Segmenter()

        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            for r in rows:
                yield (r[0], *r[k:], seg.ends(r[1], canon_lang(r[2]) if lang_col else None))

        return fn

    schema = ", ".join([f"`{id_col}` {types[id_col]}", *(f"`{c}` {types[c]}" for c in extra), "ends array<int>"])
    return map_rows(df.select(*cols), make, schema)


def sentence_units(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """(id, unit_no, first_pos, last_pos, unit): every sentence unit of every row."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    cols = [id_col, text_col, *([lang_col] if lang_col else [])]

    def make():
        seg = Segmenter()

        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            for r in rows:
                for i, (a, b, u) in enumerate(seg.units(r[1], canon_lang(r[2]) if lang_col else None), 1):
                    yield r[0], i, a, b, u

        return fn

    return map_rows(df.select(*cols), make, f"`{id_col}` {types[id_col]}, unit_no int, first_pos int, last_pos int, unit string")


def all_units(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """(rec_table, rec_id, unit_no, first_pos, last_pos, unit): the units of every document and of the latest delivery of every sentence row."""
    cols = ("unit_no", "first_pos", "last_pos", "unit")
    d = sentence_units(documents, "doc_id", "text", "lang").select(F.lit("documents").alias("rec_table"), F.col("doc_id").alias("rec_id"), *cols)
    s = sentence_units(latest(sentences, "sentenceid", "hawaiiantext"), "sentenceid", "hawaiiantext")
    return d.unionByName(s.select(F.lit("sentences").alias("rec_table"), F.col("sentenceid").alias("rec_id"), *cols))


def found(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """p1_found: ends of the sentences that another one follows, in typed documents and in sentence rows (each id once)."""
    d = sentence_ends(documents.where("medium = 'typed'"), "doc_id", "text", "lang")
    d = d.select(F.lit("documents").alias("rec_table"), F.col("doc_id").alias("rec_id"), "ends")
    s = sentence_ends(sentences.where(F.col("sentenceid").isNotNull()), "sentenceid", "hawaiiantext", extra=("created",))
    s = s.groupBy("sentenceid").agg(F.max_by("ends", F.struct(F.col("created").isNotNull(), "created", "ends")).alias("ends"))
    s = s.select(F.lit("sentences").alias("rec_table"), F.col("sentenceid").alias("rec_id"), "ends")
    return d.unionByName(s).select("rec_table", "rec_id", F.explode(F.col("ends").cast("array<bigint>")).alias("end_pos"))

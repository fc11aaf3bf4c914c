"""Problem 2: noise in text from scanned pages.

Each scanned document is read line by line: running headers and page numbers are told from running text by where they stand, by the document's title or
its month and year, and by the run of page numbers (edge-line removal). Words broken at a line's end are put together over page turns; whether the hyphen
goes or stays is decided by evidence: how often the joined and the hyphenated form come in the corpus, and whether both parts are words (hyphen evidence).
Misrecognised characters are found in two ways: a mark or digit inside a word is one by itself; a word of letters only is one when replacing a known
misreading by what it stands for gives a word that is far more frequent. That second search is a join in SQL: a word's anagram hash is the sum of its
characters' hashes, so taking a misreading off and putting its source on is one addition, and equal sums are candidates whatever the place; the place
is then checked, and candidates are ranked by frequency.

Null texts have no lines. A document without page turns has no headers or page numbers except by its own evidence. Repeated documents are judged each.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohana.session import cut_lineage

from .base import URL, URL_HINT, map_rows

#: What a character was read as, by what was printed: misreadings of letters by letters. Fixed values.
MISREAD = {
    "a": ["cl"], "d": ["cl", "ol"], "e": ["c"], "g": ["q"], "h": ["li", "b"], "i": ["j"], "k": ["lc", "lt"], "l": ["j"], "m": ["rn", "in", "nn"],
    "n": ["tl", "ri"], "o": ["c"], "p": ["jo"], "s": ["f"], "t": ["f"], "u": ["v", "ii"], "w": ["vv", "vr"],
    "ā": ["á", "ä", "â", "à"], "ē": ["é", "ë", "ê", "è"], "ī": ["í", "ï", "î", "ì"], "ō": ["ó", "ö", "ô", "ò"], "ū": ["ú", "ü", "û", "ù"],
}
PAIRS = [(good, bad) for good, bads in MISREAD.items() for bad in bads]
#: Marks and digits that stand for a letter inside a word, and the letters.
MARKS = {"€": "e", "«": "a", "@": "a", "|": "l", "+": "t", "ı": "r", "{": "", "•": "", "°": "ʻ", "^": "ʻ", "*": "ʻ", "0": "o", "6": "o", "1": "i", "5": "s", "9": "g", "!": "i"}
MARK_SEQ = [("r1", "n"), ("i•", "r"), ("h{", "k"), ("y)", "p")]

MONTHS = "ianuali pepeluali malaki apelila mei iune iulai aukake kepakemapa okakopa nowemapa kekemapa january february march april may june july august september october november december".split()

HYPHEN = re.compile(r"([^\W\d_]+)[-­¬=‐]\s?$")
NOT_HYPHEN = re.compile(r"(?:--|[\s][-–—])\s*$")
_LETTER = r"[^\W\d_]"
WORD = re.compile(rf"{_LETTER}+(?:[ʻ'’]{_LETTER}+)*")
HYPHENATED = re.compile(rf"(?<![\w-]){_LETTER}+(?:[ʻ'’]{_LETTER}+)*-{_LETTER}+(?:[ʻ'’]{_LETTER}+)*(?![\w-])")
TOKEN = re.compile(r"\S+")
#: A mark or digit within or beside letters that no spelling has.
MARK_IN_WORD = re.compile(rf"[€«@|{{•°^]|{_LETTER}[+*]|[+*]{_LETTER}|ı|{_LETTER}y?\){_LETTER}|{_LETTER}!{_LETTER}|^!{_LETTER}|{_LETTER}[01569]|[01569]{_LETTER}")
ODD_LINE = re.compile(rf"[€«@|{{•°^+*ı]|{_LETTER}[)!]\S|!{_LETTER}|{_LETTER}!\s+{_LETTER}|{_LETTER}\d|\d{_LETTER}")
NUMBERISH = re.compile(r"^[\d.,:/$–-]*(?:st|nd|rd|th|s|am|pm)?$", re.I)
SUSPECT = re.compile("|".join(sorted({re.escape(b) for _, b in PAIRS}, key=len, reverse=True)))
CORE = re.compile(r"^[“”\"‹›(\[.,;:?…—–-]+|[“”\"’‹›)\].,;:?!…—–-]+$")

DIGITY = r"[0-9OoQlI|ıSsBbZzGgcDt*€@«!°.,:;'^+?)]"
PAGE_STYLES = {
    "bracket": re.compile(rf"^\s*[\[({{|]\s*({DIGITY}{{1,4}})\s*[\])}}|]\s*$"),
    "dash": re.compile(rf"^\s*[—–-]\s*({DIGITY}{{1,4}})\s*[—–-]\s*$"),
    "aoao": re.compile(rf"^\s*[ʻ‘'*°^]?\S{{0,2}}[Aa4@«]\S{{2,5}}\s+({DIGITY}{{1,4}})\s*$"),
}
BARE = re.compile(rf"^\s*({DIGITY}{{1,4}})\s*$")
AOAO = re.compile(r"aoao|[a-z@«0€c*|1!{^°]{4}")


def fold(s: str) -> str:
    """Upper case without accents and okina."""
    s = unicodedata.normalize("NFD", s)
    return "".join(c for c in s if not unicodedata.combining(c) and c not in "ʻ‘’'`ʼʽ").upper()


def near(a: str, b: str, most: int) -> bool:
    """Is the edit distance of a and b at most ``most``?"""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        if min(cur) > most:
            return False
        prev = cur
    return prev[-1] <= most


_DIGIT_OF = str.maketrans("OoQDlI|ı!cSsBbZzGgt", "0000111110558822997")


def number(s: str) -> int | None:
    """The number that a possibly misread string of digits shows; None where too little of it is digits."""
    t = s.strip().strip(".,:;'")
    real = sum(c.isdigit() for c in t)
    if not t or not (real or t.translate(_DIGIT_OF).isdigit() and len(t) > 1):
        return None
    d = re.sub(r"\D", "", t.translate(_DIGIT_OF))
    return int(d) if d else None


def _caps(s: str) -> bool:
    up = sum(map(str.isupper, s))
    return up >= 3 and up >= 3 * sum(map(str.islower, s))


SPECKS = "*.,|·•'"


def _header_cores(line: str) -> list[tuple[str, int | None]]:
    """What a header line may say besides its page number: (upper-case text, number), without specks of dirt; most of the line first."""
    toks = [t.strip(SPECKS) if len(t.strip(SPECKS)) > 1 else t for t in fold(line).split() if t.strip(SPECKS)]
    out: list[tuple[str, int | None]] = [(" ".join(toks), None)]
    if len(toks) > 1:
        if len(toks[-1]) <= 4 and (n := number(toks[-1])) is not None:
            out.append((" ".join(toks[:-1]), n))
        if len(toks[0]) <= 4 and (n := number(toks[0])) is not None:
            out.append((" ".join(toks[1:]), n))
    return out


def _month_year(core: str) -> bool:
    m = re.match(r"^(\S+)\s(\S{3,5})$", core) or re.match(r"^(\S+?)[*.,|1IC](\S{4})$", core)
    if not m or sum(c.isdigit() for c in m.group(2)) < 2:
        return False
    w = m.group(1).lower()
    return any(near(w, mo, 1 if len(mo) < 6 else 2) for mo in MONTHS)


def roles(text: str, title: str | None) -> list[str]:
    """Of each line: blank, text, header, pageno, or number (a line of figures that is no page number)."""
    lines = text.split("\n")
    role = ["text" if ln.strip() else "blank" for ln in lines]
    key = re.sub(r"\s+", " ", fold(title)).strip() if title else None
    cores: dict[int, str] = {}
    head_num: dict[int, int] = {}
    style_of: dict[int, tuple[str, int | None]] = {}
    for i, ln in enumerate(lines):
        if role[i] == "blank":
            continue
        if _caps(ln):
            tried = _header_cores(ln)
            for core, num in tried:
                if (key and len(key) > 2 and near(core, key, max(1, len(key) // 8))) or _month_year(core):
                    role[i] = "header"
                    if num is not None:
                        head_num[i] = num
                    break
            if role[i] == "header":
                continue
            cores[i], num = tried[-1]
            if num is not None and re.search(r"\s{2,}", ln.strip()):
                head_num[i] = num
        if len(ln.split(None, 3)) < 4:  # no page number has more parts
            for name, rx in PAGE_STYLES.items():
                m = rx.match(ln)
                if m and number(m.group(1)) is not None and (name != "aoao" or near(fold(ln.split()[0]).lower(), "aoao", 1)):
                    role[i], style_of[i] = "pageno", (name, number(m.group(1)))
                    break
            else:
                m = BARE.match(ln)
                if m and number(m.group(1)) is not None:
                    role[i], style_of[i] = "number", ("bare", number(m.group(1)))
    solid = [i for i, r in enumerate(role) if r != "blank"]
    after = {a: b for a, b in zip(solid, solid[1:])}
    before = {b: a for a, b in zip(solid, solid[1:])}
    # Headers whose title is unknown: capitals at a page's top, or that come again.
    if not any(r == "header" for r in role):
        again = Counter(cores.values())
        for i, core in cores.items():
            top = i in before and role[before[i]] == "pageno"
            if i in head_num or top or again[core] > 1 and len(core) > 3:
                role[i] = "header"
        known = list(dict.fromkeys(cores[i] for i in cores if role[i] == "header"))
        if known:
            for i, core in cores.items():
                if role[i] == "text" and any(near(core, k, max(1, len(k) // 8)) for k in known):
                    role[i] = "header"
    # Page numbers that stand alone: only where no other style is in use, in step with the pages.
    if not any(r == "pageno" for r in role):
        cand = [i for i in solid if role[i] == "number"]
        heads = [i for i in solid if role[i] == "header"]
        turn = {i for i in cand if i in after and role[after[i]] == "header"}
        alone = {i for i in cand if not (i in before and role[before[i]] == "number") and not (i in after and role[after[i]] == "number")}
        vals = {i: style_of[i][1] for i in cand}
        chosen: set[int] = set()
        for i in cand:
            nxt = after.get(i)
            if nxt in head_num and role[nxt] == "header" and head_num[nxt] - vals[i] in (0, 1):
                chosen.add(i)
        # The longest run of numbers that goes up by one from page to page, five lines apart at least; the first of equal ones.
        best: dict[int, tuple[int, int]] = {}  # by number: (length of its longest run so far, last line of it)
        length: dict[int, int] = {}
        back: dict[int, int | None] = {}
        waiting = 0
        for i in cand:
            while waiting < len(cand) and cand[waiting] < i - 4:
                j = cand[waiting]
                waiting += 1
                if vals[j] is not None and length[j] > best.get(vals[j], (0, 0))[0]:
                    best[vals[j]] = (length[j], j)
            n, back[i] = best.get(vals[i] - 1, (0, None)) if vals[i] is not None else (0, None)
            length[i] = n + 1
        at: int | None = max(cand, key=lambda i: (length[i], -i), default=None)
        run: list[int] = []
        while at is not None:
            run.append(at)
            at = back[at]
        run.reverse()
        if len(run) > 1:
            chosen |= set(run)
        if not chosen:
            chosen = {i for i in turn if i in alone and i not in heads}
        if chosen and not run:
            run = sorted(chosen)
        anchor = next(iter(sorted(chosen)), None)
        if anchor is not None:
            for i in cand:
                if i in turn and i in alone and abs(vals[i] - vals[anchor]) <= len(heads) + 2:
                    chosen.add(i)
        for i in chosen:
            role[i] = "pageno"
    return role


def lines_of(text: str, title: str | None) -> Iterator[tuple[int, str, str, str | None, int]]:
    """What pass one says of a scanned document: (line_no, kind, word, ...) where kind is a fault, or 'word' for a suspect of letters only.

    For a suspect: word, the number of its characters that stand in this line (the rest stand in the next line of text). 'break': the broken word, hyphenated.
    """
    lines = text.split("\n")
    role = roles(text, title)
    running = [i for i, r in enumerate(role) if r == "text"]
    follow = {a: b for a, b in zip(running, running[1:])}
    for i, r in enumerate(role):
        if r in ("header", "pageno"):
            yield i + 1, r, None, None, 0
    carried = None  # (fragment, its line) broken off at the end of the line before
    for i in running:
        line = lines[i]
        tail = None
        m = None if NOT_HYPHEN.search(line) else HYPHEN.search(line)
        if m and i in follow:
            yield i + 1, "hyphen", None, None, 0
            tail = m
        toks = [(t.start(), t.group()) for t in TOKEN.finditer(line)] if ODD_LINE.search(line) else ()
        glyph = any(_marked(raw.rstrip("-­¬=‐") if tail is not None and k == len(toks) - 1 else raw, toks[k + 1][1] if k + 1 < len(toks) else "") for k, (_, raw) in enumerate(toks))
        body = line[: tail.end(1)] if tail is not None else line
        frag = None
        if tail is not None:
            frag = WORD.findall(tail.group(1).lower())[-1]
            start = re.search(r"\S+$", body)
            whole = WORD.findall(start.group().lower()) if start else []
            frag = whole[-1] if whole else frag
        if "/" in body or URL_HINT.search(body):
            body = " ".join(t for t in body.split() if "/" not in t and not URL.search(t))
        words = WORD.findall(body.lower())
        if carried is not None and (b := broken_word(carried[0], line.strip())):
            yield carried[1] + 1, "break", b, i + 1, 0
        if carried is not None and words:
            w = carried[0] + words[0]
            if SUSPECT.search(w):
                yield carried[1] + 1, "word", w, i + 1, len(carried[0])
            words = words[1:]
        if frag is not None and words:
            words = words[:-1]
        for w in words:
            if len(w) > 1 and SUSPECT.search(w):
                yield i + 1, "word", w, i + 1, len(w)
        carried = (frag, i) if frag is not None else None
        if glyph:
            yield i + 1, "glyph", None, None, 0


def _marked(tok: str, nxt: str) -> bool:
    """Does a token hold a mark or digit that stands for a letter?"""
    if "$" in tok or tok in ("(!)", "(?)") or URL_HINT.search(tok) and URL.search(tok):
        return False
    core = CORE.sub("", tok)
    if not core or not any(c.isalpha() for c in core) and core not in MARKS:
        return False
    if NUMBERISH.match(core):
        return False
    if MARK_IN_WORD.search(core):
        return True
    # An exclamation mark that ends a word though the sentence goes on.
    return bool(re.match(rf"^[(“]?{_LETTER}+(?:[ʻ]{_LETTER}+)*!$", tok) and nxt[:1].islower() and len(tok) < 5)


SCHEMA_ONE = "doc_id long, line_no int, kind string, word string, next_no int, here int"


def pass_one(documents: DataFrame) -> DataFrame:
    """Line faults and suspect words of the scanned documents."""

    def make():
        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            for i, t, title in rows:
                if t:
                    for x in lines_of(t, title):
                        yield (i, *x)

        return fn

    return map_rows(documents.where("medium = 'scan'").select("doc_id", "text", "title"), make, SCHEMA_ONE)


def lexicon(documents: DataFrame) -> DataFrame:
    """(word, n, outside): every word of letters, and every hyphenated word within a line, in all documents, counted, and how often it comes outside scans;
    each task counts before the shuffle."""

    def make():
        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            c: Counter = Counter()
            out: Counter = Counter()
            for t, medium in rows:
                if t:
                    low = t.lower()
                    count = c if medium == "scan" else out
                    count.update(WORD.findall(low))
                    if "-" in low:
                        count.update(HYPHENATED.findall(low))
                if len(c) + len(out) > 500_000:
                    yield from ((w, n, 0) for w, n in c.items())
                    yield from ((w, n, n) for w, n in out.items())
                    c.clear()
                    out.clear()
            yield from ((w, n + out[w], out[w]) for w, n in c.items())
            yield from ((w, n, n) for w, n in out.items() if w not in c)

        return fn

    return map_rows(documents.select("text", "medium"), make, "word string, n long, outside long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"))


def anagram(c) -> F.Column:
    """The sum of the characters' hashes."""
    return F.aggregate(F.transform(F.split(c, ""), lambda x: F.pmod(F.xxhash64(x), F.lit(1 << 40))), F.lit(0).cast("long"), lambda a, x: a + x)


def corrections(lex: DataFrame, ratio: float = 10.0, outside: float = 0.5, least: int = 1) -> DataFrame:
    """(word, fixed, at): words that a known misreading turns into a far more frequent one, with the most frequent such word; at: characters before the misreading.

    Far more frequent: at least ``ratio`` times; and the word's share outside scans is at most ``outside`` of the other's, for a word of its own comes in all
    media. Both are shares, so a corpus of more rows of the same kind is judged alike.
    """
    spark = lex.sparkSession
    pairs = F.array(*[F.struct(F.lit(g).alias("good"), F.lit(b).alias("bad")) for g, b in PAIRS])
    w = lex.where(F.col("word").rlike(SUSPECT.pattern)).withColumn("p", F.explode(F.filter(pairs, lambda p: F.col("word").contains(p["bad"]))))
    w = w.select("word", "n", "outside", F.col("p.good").alias("good"), F.col("p.bad").alias("bad"))
    table = spark.createDataFrame(PAIRS, "good string, bad string")
    delta = table.select("good", "bad", (anagram(F.col("good")) - anagram(F.col("bad"))).alias("d"))
    w = w.join(F.broadcast(delta), ["good", "bad"]).select("word", "n", "outside", "good", "bad", (anagram(F.col("word")) + F.col("d")).alias("av"))
    v = lex.where(F.col("n") >= least * ratio).select(anagram(F.col("word")).alias("av"), F.col("word").alias("fixed"), F.col("n").alias("m"), F.col("outside").alias("m_outside"))
    j = w.join(v, "av").where((F.col("m") >= ratio * F.col("n")) & (F.col("outside") * F.col("m") <= outside * F.col("n") * F.col("m_outside")))
    place = F.filter(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: (F.substring(F.col("word"), i, F.length("bad")) == F.col("bad"))
        & (F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.col("good"), F.substring(F.col("word"), i + F.length("bad"), F.length("word"))) == F.col("fixed")),
    )
    j = j.withColumn("_p", place).where(F.size("_p") > 0)
    best = F.max(F.struct("m", "fixed", (F.element_at("_p", 1) - 1).alias("at"))).alias("b")
    return j.groupBy("word").agg(best).select("word", F.col("b.fixed").alias("fixed"), F.col("b.at").alias("at"))


def kept_hyphens(pairs: DataFrame, lex: DataFrame, rare: int = 3) -> DataFrame:
    """(word, fixed) from (word): a broken word written ``before-after``, where the hyphen stays.

    It stays where the hyphenated form comes within lines more often than the joined one, or where neither comes and both parts are words of their own
    outside scans, ``rare`` times or more. Otherwise the parts are joined. Lines' own fragments don't speak: parts are counted outside scans.
    """
    p = pairs.select("word").distinct()
    a, b = F.element_at(F.split("word", "-"), 1), F.element_at(F.split("word", "-"), -1)
    ask = p.select("word", F.explode(F.array(F.struct(F.lit("h").alias("k"), F.col("word").alias("w")), F.struct(F.lit("j").alias("k"), F.concat(a, b).alias("w")), F.struct(F.lit("a").alias("k"), a.alias("w")), F.struct(F.lit("b").alias("k"), b.alias("w")))).alias("q"))
    got = ask.select("word", "q.k", "q.w").join(lex.select(F.col("word").alias("w"), "n", "outside"), "w")

    def seen(k: str, c: str):
        return F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0))

    g = got.groupBy("word").agg(seen("h", "n").alias("h"), seen("j", "n").alias("j"), seen("a", "outside").alias("a"), seen("b", "outside").alias("b"))
    return g.where((F.col("h") > F.col("j")) | ((F.col("h") == 0) & (F.col("j") == 0) & (F.col("a") >= rare) & (F.col("b") >= rare))).select("word", F.col("word").alias("fixed"))


def found(documents: DataFrame) -> DataFrame:
    """p2_found: one row per line and fault."""
    one = pass_one(documents).where("kind <> 'break'")
    fix = corrections(cut_lineage(lexicon(documents)))
    # Faults of a line by itself have no word; each goes by under a key of its own, that no word has, so they are spread over all tasks.
    key = F.coalesce("word", F.concat_ws(" ", F.lit(""), "doc_id", "line_no"))
    j = one.withColumn("word", key).join(fix, "word", "left").where("kind <> 'word' OR fixed IS NOT NULL")
    line = F.when((F.col("kind") == "word") & (F.col("at") >= F.col("here")), F.col("next_no")).otherwise(F.col("line_no"))
    fault = F.when(F.col("kind") == "word", F.lit("glyph")).otherwise(F.col("kind"))
    return j.select("doc_id", line.cast("long").alias("line_no"), fault.alias("fault")).distinct()


def broken_word(before: str, after: str) -> str | None:
    """The word that a line's end breaks, written with a hyphen in small letters."""
    a, b = WORD.findall(before[before.rfind(" ") + 1 :].lower()), WORD.match(after.lower())
    return f"{a[-1]}-{b.group()}" if a and b else None


def rebuild(text: str, title: str | None, fixes: dict[str, str]) -> str:
    """The text in continuous paragraphs: edge lines out, broken words joined, words corrected, lines of a paragraph run together."""
    lines = text.split("\n")
    role = roles(text, title)
    paras: list[str] = []
    cur = ""
    gap = True
    for i, r in enumerate(role):
        if r == "blank":
            # A blank line beside an edge line belongs to the page, not to the text.
            near_edge = any(role[j] in ("header", "pageno") for j in (i - 1, i + 1) if 0 <= j < len(role))
            gap = gap or not near_edge
            continue
        if r in ("header", "pageno"):
            continue
        ln = lines[i]
        if cur and (gap or re.match(r"^\s{2,}\S", ln) or r == "number"):
            paras.append(cur)
            cur = ""
        gap = False
        s = re.sub(r"(?:--|\s[–—-])\s*$", "", ln).strip()
        m = HYPHEN.search(cur) if cur else None
        if m and not NOT_HYPHEN.search(cur):
            stem = cur.rstrip()[:-1]
            cur = (stem + "-" if broken_word(stem, s) in fixes else stem) + s
        else:
            cur = f"{cur} {s}" if cur else s
    if cur:
        paras.append(cur)

    def fix(m: re.Match) -> str:
        w = m.group()
        f = fixes.get(w.lower())
        return w if f is None else f[:1].upper() + f[1:] if w[:1].isupper() else f

    out = []
    for p in paras:
        p = " ".join(_unmark(t) for t in p.split(" "))
        out.append(WORD.sub(fix, p) if fixes else p)
    return "\n\n".join(out)


def _unmark(tok: str) -> str:
    """A token with the marks in it read as the letters they stand for."""
    if not _marked(tok, ""):
        return tok
    for bad, good in MARK_SEQ:
        tok = tok.replace(bad, good)
    return re.sub(rf"(?<={_LETTER})[{re.escape(''.join(MARKS))}](?={_LETTER}|$)|[{re.escape(''.join(MARKS))}](?={_LETTER})", lambda m: MARKS[m.group()], tok)


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, text): every scanned document repaired. Corrections and hyphens that stay come to each document through the join on its own words."""
    one = pass_one(documents).where("kind IN ('word', 'break')").select("doc_id", "word", "kind").distinct()
    lex = cut_lineage(lexicon(documents))
    known = corrections(lex).select("word", "fixed").unionByName(kept_hyphens(one.where("kind = 'break'"), lex))
    fixes = one.join(known, "word").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "fixed")))).alias("fixes"))
    d = documents.where("medium = 'scan'").select("doc_id", "text", "title").join(fixes, "doc_id", "left")

    def make():
        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            for i, t, title, f in rows:
                yield i, None if t is None else rebuild(t, title, dict(f) if f else {})

        return fn

    return map_rows(d.select("doc_id", "text", "title", "fixes"), make, "doc_id long, text string")

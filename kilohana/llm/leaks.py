"""Problem 9: evaluation texts leaking into training text.

Template canonicalisation: words are folded (case, accents, okina marks, look-alike and wide forms, line-end hyphens), and numbers, months, units and names
(the evaluation set's, and capitalised words of a document that no passage has) become typed placeholders. Windows of ``WINDOW`` canonical words of every
evaluation passage are hashed into a table; every document's windows are hash-joined with it. Windows that meet are gathered by item and diagonal, and on
each diagonal the words are compared in full: a word agrees where it is the same, a misreading, or a slot filled with another value of its type, if the two
values stand for each other one to one all along the diagonal (slot consistency); any other word is changed. A leak is a stretch of at least ``RUN`` words of
the passage, at most ``CHANGED`` of them changed, at least ``LITERAL`` the very words, or the whole passage where that is shorter.

Windows seed, but for stock ones, those of more than ``TELL_SHARE`` of the passages; a stretch of stock windows only is stock phrasing. Windows reach every
stretch with up to two changed words in ``RUN``. Those with more, up to ``CHANGED``, are seeded by the telling words (words of few
passages) that stand at the same distance in both texts, wherever the changed words are; ``TELLING`` of them must agree, for among the words of all
passages three in four agree by chance. A stretch begins and ends with a word that agrees or is a misreading of the passage's: another word there cannot
be told from text that goes elsewhere.

The evaluation set is the stated query set: names and telling words are told from all of it, and it is met in blocks of ``MAX_BLOCK`` passages, so no hashed
table holds more; the size of a block changes no result. Null or empty texts and passages hold nothing; repeated documents are each reported; ids that
repeat in the evaluation set count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans
from .base import CONFUSABLE, INVISIBLE, OKINA_MARKS, SPACES, WIDE, map_rows

WINDOW, RUN = 5, 16
#: Passages in one block of the query set.
MAX_BLOCK = 2_000
#: Blocks that one scan of the documents meets, each text cut into words once for all of them.
BLOCKS_A_SCAN = 8
#: Share of changed words borne in a stretch.
CHANGED = 0.25
#: Telling words: those of at most this share of the passages (three at least); so many must agree in a stretch that windows don't show.
TELL_SHARE, TELLING = 0.1, 3

_FOLD = {ord(k): v for k, v in {**WIDE, **CONFUSABLE, **{s: " " for s in SPACES}}.items()}
_FOLD |= {ord(c): None for c in INVISIBLE + OKINA_MARKS + "ʻ"}
for _c in range(0xC0, 0x250):
    _b = "".join(x for x in unicodedata.normalize("NFKD", chr(_c)) if not unicodedata.combining(x))
    if _b and _b != chr(_c) and ord(_b[0]) < 128:
        _FOLD.setdefault(_c, _b)
_FOLD |= {c: None for c in range(0x300, 0x370)}
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-­¬=‐]\s?\n\s*(?=[^\W\d_])")
_MARKS = re.compile(r"\[\d\d:\d\d:\d\d\]")
_INNER = re.compile(r"(?<=[^\W\d_])[€«@|{}+•°^*!)](?=[^\W_])")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")
_ODD = re.compile(r"[^\x00-\x7f]+")
MONTHS = frozenset("ianuali pepeluali malaki apelila mei iune iulai aukake kepakemapa okakopa nowemapa kekemapa january february march april may june july august september october november december".split())
UNITS = frozenset("kapuai iniha mile feet foot miles inches pounds yards acres hola dollars kenikeni paona eka".split())
#: Types of slots, and their numbers among the words.
NUM, MONTH, UNIT, NAME = 1, 2, 3, 4
#: Share of a stretch with slots filled anew that must be the very words.
LITERAL = 0.5


def fold(text: str) -> str:
    """Folded text in its case: runs outside ASCII are mapped."""
    return text if text.isascii() else _ODD.sub(_fold_run, text)


def _fold_run(m: re.Match, seen: dict = {}) -> str:  # noqa: B006
    r = m.group()
    f = seen.get(r)
    if f is None:
        f = r.translate(_FOLD)
        if len(r) < 4 and len(seen) < 100_000:
            seen[r] = f
    return f


def words(text: str, medium: str | None = None, title: str | None = None) -> list[str]:
    """The folded words of a text, in their case; page furniture of scans and time marks of transcripts are left out."""
    if medium == "scan":
        role = scans.roles(text, title)
        text = _INNER.sub("", "\n".join(ln for ln, r in zip(text.split("\n"), role) if r == "text"))
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    if "[0" in text:
        text = _MARKS.sub(" ", text)
    return _TOKEN.findall(fold(text))


def names_of(passages: list[str]) -> frozenset[str]:
    """Words that come capitalised within sentences and never small."""
    big: set[str] = set()
    small: set[str] = set()
    for p in passages:
        for m in re.finditer(r"(?<![.!?“\"]\s)(?<!^)\b[^\W\d_][\wʻ'’]*", p or ""):
            w = m.group().lstrip("ʻ'‘’")
            f = _TOKEN.findall(fold(w).lower())
            if len(f) == 1 and len(f[0]) > 2:
                (big if w[:1].isupper() else small).add(f[0])
    return frozenset(big - small)


def alike(a: str, b: str) -> bool:
    """Is one word a misreading of the other: but for one or two letters in a row the same?"""
    n = min(len(a), len(b))
    if n < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 2


def kind_of(w: str, names: frozenset[str]) -> int:
    """The type of the slot that a folded small word fills, 0 for none."""
    return NUM if w.isdigit() else MONTH if w in MONTHS else UNIT if w in UNITS else NAME if w in names else 0


def templates(w: list[str], names: frozenset[str], window: int, slots: bool) -> list[str]:
    """Every window of the words, with placeholders for slots."""
    c = [str(kind_of(x, names) or x) if slots else x for x in w]
    return [" ".join(c[i : i + window]) for i in range(len(c) - window + 1)]


@dataclass
class Vocabulary:
    """What is told from all passages of the query set together: their names, and the telling words."""

    names: frozenset[str]
    telling: frozenset[str]
    stock: frozenset[str] = frozenset()  # template windows of so many passages that they tell none

    @classmethod
    def of(cls, passages: list[str], window: int = WINDOW, slots: bool = True) -> Vocabulary:
        names = names_of(passages)
        df: Counter = Counter()
        wf: Counter = Counter()
        for p in passages:
            w = [x.lower() for x in words(p or "")]
            df.update(set(w))
            wf.update(set(templates(w, names, window, slots)))
        most = max(3, int(TELL_SHARE * len(passages)))
        return cls(names, frozenset(x for x, n in df.items() if n <= most), frozenset(x for x, n in wf.items() if n > most))


def _in_runs(same: np.ndarray, run: int) -> np.ndarray:
    """How many hold in each run of columns."""
    c = np.zeros((len(same), same.shape[1] + 1), dtype=np.int16)
    np.cumsum(same, axis=1, out=c[:, 1:])
    return c[:, run:] - c[:, :-run]


class Index:
    """The hashed template windows of a block of passages. Built once a task from the block's rows."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, vocabulary: Vocabulary | None = None, slots: bool = True) -> None:
        self.window, self.slots = window, slots
        vocabulary = vocabulary or Vocabulary.of([p for _, p in items], window, slots)
        self.names = vocabulary.names
        self.seen: dict[str, int] = {}  # words as they stand in documents, and their numbers
        self.ids: dict[str, int] = {}  # canonical or plain word to its number
        self.slot: dict[str, int] = {}
        self.items = []
        self.words: list[list[str]] = []
        canon_rows = []
        self.short: list[tuple[int, int, str]] = []  # passages of fewer words than a window are looked for as they are
        for item, p in items:
            w = [x.lower() for x in words(p or "")]
            if len(w) < window:
                if w:
                    self.short.append((item, len(w), f" {' '.join(w)} "))
                continue
            plain = np.array([self.ids.setdefault(x, len(self.ids) + 8) for x in w], dtype=np.int64)
            canon_rows.append(np.array([self._canon(x) for x in w], dtype=np.int64))
            self.items.append((item, plain))
            self.words.append(w)
        self.length = np.array([len(p) for _, p in self.items], dtype=np.int64)
        pad = np.full(2 * RUN, -1, dtype=np.int64)
        self.start, flat = [], [pad]
        for _, plain in self.items:
            self.start.append(sum(map(len, flat[-2:])) + (self.start[-1] if self.start else 0) if len(flat) > 1 else len(pad))
            flat += [plain, pad]
        self.flat = np.concatenate(flat)
        self.start = np.array(self.start, dtype=np.int64)
        self.canon_of = np.zeros(len(self.ids) + 8, dtype=np.int64)
        self.canon_of[NUM : NAME + 1] = range(NUM, NAME + 1)
        for x, k in self.ids.items():
            self.canon_of[k] = self._canon(x)
        self.flat_canon = np.where(self.flat >= 0, self.canon_of[self.flat], -1)
        self.telling = np.zeros(len(self.canon_of), dtype=bool)
        for x, k in self.ids.items():
            self.telling[k] = x in vocabulary.telling
        owner = np.repeat(np.arange(len(self.items)), self.length)
        every = np.concatenate([x for _, x in self.items]) if self.items else np.zeros(0, np.int64)
        place = np.arange(len(every)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        tell = np.flatnonzero(self.telling[every])
        tell = tell[np.argsort(every[tell], kind="stable")]
        # Item, diagonal and place in the document in one number, of a document that has the word at place 0.
        self.tell_base = (owner[tell] << 51) + (((1 << 24) - place[tell]) << 25)
        self.tell_count = np.bincount(every[tell], minlength=len(self.telling))
        self.tell_first = np.cumsum(self.tell_count) - self.tell_count
        keys, at_item, at_pos = [], [], []
        for k, c in enumerate(canon_rows):
            at = np.array([i for i, x in enumerate(templates(self.words[k], self.names, window, slots)) if x not in vocabulary.stock], dtype=np.int64)
            keys.append(self.hashes(c)[at])
            at_item.append(np.full(len(at), k))
            at_pos.append(at)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.at_item = np.concatenate(at_item)[order] if keys else key
        self.at_pos = np.concatenate(at_pos)[order] if keys else key
        self.distinct, self.first, self.count = np.unique(self.key, return_index=True, return_counts=True)

    def _kind(self, w: str) -> int:
        """The type of the slot that a folded small word fills, 0 for none."""
        return kind_of(w, self.names) if self.slots else 0

    def _canon(self, w: str) -> int:
        return self._kind(w) or self.ids.setdefault(w, len(self.ids) + 8)

    def hashes(self, c: np.ndarray) -> np.ndarray:
        """A 62-bit hash of every window."""
        n = len(c) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(self.window):
            x = c[k : k + n].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ x) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(2)).astype(np.int64)

    def encode(self, w: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(plain numbers, canonical numbers) of a document's words.

        A word that no passage has is 0 in both, but a number, a month, a unit or a capitalised word among them has its type's number.
        """
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        get = seen.get
        plain = np.array([k if (k := get(x)) is not None else self._number(x) for x in w], dtype=np.int64)
        return plain, self.canon_of[plain]

    def _number(self, word: str) -> int:
        low = word.lower()
        k = self.ids.get(low) or self._kind(low) or (NAME if self.slots and word[0].isupper() and word[1:].islower() else 0)
        self.seen[word] = k
        return k

    def search(self, w: list[str], run: int = RUN, changed: float = CHANGED) -> list[tuple[int, int, int, int]]:
        """(item_id, words in the longest stretch, changed words in it, of these slots filled anew but alike) of each item that leaks."""
        line = f" {' '.join(w).lower()} " if self.short else ""
        out = [(item, n, 0, 0) for item, n, p in self.short if p in line]
        plain, canon = self.encode(w)
        best: dict[int, tuple[int, int, int]] = {}
        seeds = self._by_windows(plain, canon, run, changed)
        for x in seeds:
            i, d = int(x >> 32), int(x & 0xFFFFFFFF) - (1 << 30)
            length, bad = self._stretch(plain, i, d, run, changed)
            if length and length > best.get(i, (0, 0, 0))[0]:
                best[i] = (length, bad, 0)
        for x in np.union1d(seeds, self._by_telling(plain, canon, run, changed)):
            i, d = int(x >> 32), int(x & 0xFFFFFFFF) - (1 << 30)
            length, bad, slots = self._changed_stretch(w, plain, i, d, run, changed)
            if length > best.get(i, (0, 0, 0))[0]:
                best[i] = (length, bad, slots)
        return out + [(self.items[i][0], *x) for i, x in best.items()]

    def _by_windows(self, plain: np.ndarray, canon: np.ndarray, run: int, changed: float) -> np.ndarray:
        """Item and diagonal, in one number, where windows meet and enough words around them agree."""
        h = self.hashes(canon)
        if not len(h) or not len(self.distinct):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.distinct, h)
        at[at == len(self.distinct)] = 0
        hit = np.nonzero(self.distinct[at] == h)[0]
        if not len(hit):
            return np.zeros(0, np.int64)
        c = self.count[at[hit]]
        first = self.first[at[hit]]
        total = int(c.sum())
        doc = np.repeat(hit, c)
        idx = np.repeat(first, c) + (np.arange(total) - np.repeat(np.cumsum(c) - c, c))
        item, pos = self.at_item[idx], self.at_pos[idx]
        diag = doc - pos
        key = item * (1 << 32) + (diag + (1 << 30))
        # Words that agree within RUN of each window, for all of them at once: a stretch needs its share in some run around it.
        return self._agreeing(key, item, pos, doc, np.arange(-(run - 1), run + self.window), plain, canon, run, 1 - changed, 0)

    def _agreeing(self, key: np.ndarray, item: np.ndarray, pos: np.ndarray, doc: np.ndarray, off: np.ndarray, plain: np.ndarray, canon: np.ndarray, run: int, share: float, less: int) -> np.ndarray:
        """The distinct keys around whose places some run holds its share of the very words, less ``less``, or of canonical words with ``LITERAL`` very ones."""
        pad = np.full(2 * RUN, -2, np.int64)
        text, typed = np.concatenate([pad, plain, pad]), np.concatenate([pad, canon, pad])
        good = np.zeros(len(key), dtype=bool)
        for a in range(0, len(key), 4096):
            b = slice(a, a + 4096)
            at, of = (doc[b] + 2 * RUN)[:, None] + off, (self.start[item[b]] + pos[b])[:, None] + off
            need = np.minimum(run, self.length[item[b]])[:, None]
            same = text[at] == self.flat[of]
            n = _in_runs(same, run)
            hit = (n >= need * share - less).any(axis=1)
            # With slots filled anew: fewer of the very words, but two telling ones among them.
            some = np.flatnonzero(~hit & (n >= need * LITERAL - less / 2).any(axis=1)) if self.slots else ()
            if len(some):
                tells = _in_runs(same[some] & self.telling[text[at[some]]], run) >= 2
                hit[some] = (tells & (n[some] >= need[some] * LITERAL - less / 2) & (_in_runs(typed[at[some]] == self.flat_canon[of[some]], run) >= need[some] * share - less / 2)).any(axis=1)
            good[b] = hit
        return np.unique(key[good])

    def _by_telling(self, plain: np.ndarray, canon: np.ndarray, run: int, changed: float) -> np.ndarray:
        """Item and diagonal, in one number, where TELLING telling words stand within two runs and enough words around them agree."""
        c = self.tell_count[plain]
        hit = np.flatnonzero(c)
        if len(hit) < TELLING:
            return np.zeros(0, np.int64)
        c = c[hit]
        total = int(c.sum())
        doc = np.repeat(hit, c)
        idx = np.repeat(self.tell_first[plain[hit]] - np.cumsum(c) + c, c) + np.arange(total)
        all_ = np.sort(self.tell_base[idx] + doc * ((1 << 25) + 1))
        more = TELLING - 1
        x = all_[:-more][all_[more:] - all_[:-more] < 2 * run]
        item, doc = x >> 51, x & ((1 << 25) - 1)
        diag = ((x >> 25) & ((1 << 26) - 1)) - (1 << 24)
        key, pos = item * (1 << 32) + (diag + (1 << 30)), doc - diag
        if not len(key):
            return key
        # A stretch longer than a run may have more of its changed words in each run of it: two at most, and both ends may be misread.
        return self._agreeing(key, item, pos, doc, np.arange(-(run - 1), 2 * run), plain, canon, run, 1 - changed, 4)

    def _changed_stretch(self, w: list[str], plain: np.ndarray, i: int, d: int, run: int, changed: float) -> tuple[int, int, int]:
        """The longest stretch on a diagonal of at most the share of changed words and enough telling ones: (words, changed, slots among these).

        A slot filled with another value of its type counts as agreeing where its values stand for each other one to one all along the diagonal; ``LITERAL``
        of a stretch with such slots must be the very words.
        """
        p = self.items[i][1]
        lo, hi = max(0, -d), min(len(p), len(plain) - d)
        need = min(run, len(p))
        if hi - lo < need:
            return 0, 0, 0
        a, b = p[lo:hi], plain[lo + d : hi + d]
        same = a == b
        tells = np.concatenate([[0], np.cumsum(same & self.telling[a])])
        near = same.copy()
        slot = np.zeros(len(a), dtype=bool)
        ca = self.canon_of[a]
        filled = np.flatnonzero(~same & (ca <= NAME) & (ca > 0) & (ca == self.canon_of[b]))
        own, doc = self.words[i][lo:hi], w[lo + d : hi + d]
        if len(filled):
            # A value keeps its slot where it has one counterpart, and that one no other, also not itself.
            of: dict[str, set[str]] = {}
            by: dict[str, set[str]] = {}
            at = [(k, own[k], doc[k].lower()) for k in filled.tolist()]
            for x, y in [(own[k], own[k]) for k in np.flatnonzero(same & (ca <= NAME) & (ca > 0)).tolist()] + [(x, y) for _, x, y in at]:
                of.setdefault(x, set()).add(y)
                by.setdefault(y, set()).add(x)
            slot[[k for k, x, y in at if len(of[x]) == 1 and len(by[y]) == 1]] = True
            near |= slot
        for k in np.flatnonzero(~near).tolist():
            x, y = own[k], doc[k]
            if len(x) > 3 and -2 < len(x) - len(y) < 2:
                near[k] = alike(x, y.lower())
        literal = np.concatenate([[0], np.cumsum(near & ~slot)])
        # From s to t the share holds where e[t] >= e[s]; the least e so far gives the first s.
        e = np.concatenate([[0.0], np.cumsum(near - (1.0 - changed))])
        least = np.minimum.accumulate(np.where(near, e[:-1], np.inf))
        best = (0, 0, 0)
        for t in np.flatnonzero(near[need - 1 :] & (e[need:] >= least[: len(near) - need + 1] - 1e-9)) + need:
            s = int(np.argmax(least[: t - need + 1] <= e[t] + 1e-9))
            if t - s > best[0] and tells[t] - tells[s] >= TELLING and literal[t] - literal[s] >= LITERAL * (t - s):
                best = (int(t - s), int((~same[s:t]).sum()), int(slot[s:t].sum()))
        return best

    def _stretch(self, plain: np.ndarray, i: int, d: int, run: int, changed: float) -> tuple[int, int]:
        """The longest stretch on a diagonal where words agree but for a changed one here and there: (words, changed)."""
        p = self.items[i][1]
        lo, hi = max(0, -d), min(len(p), len(plain) - d)
        need = min(run, len(p))
        if hi - lo < need:
            return 0, 0
        a, b = p[lo:hi], plain[lo + d : hi + d]
        same = a == b
        # Highest sum of +1 for the same word and -1/changed + 1 for another gives the stretch's ends.
        s = np.where(same, 1.0, -(1.0 - changed) / changed)
        best, start, cur, cur_start, end = 0.0, 0, 0.0, 0, 0
        edge = np.flatnonzero(np.diff(same.astype(np.int8))) + 1
        bounds = [0, *edge.tolist(), len(s)]
        for x, y in zip(bounds, bounds[1:]):
            if same[x]:
                if cur <= 0:
                    cur, cur_start = 0.0, x
                cur += y - x
                if cur > best:
                    best, start, end = cur, cur_start, y
            else:
                cur += s[x] * (y - x)
        n = end - start
        bad = int((~same[start:end]).sum())
        if n < need:
            return 0, 0
        return n, bad


def blocks_of(items: DataFrame, size: int = MAX_BLOCK) -> list[list[tuple[int, str]]]:
    """The query set in blocks of bounded size, one row per id."""
    rows = items.where("item_id IS NOT NULL AND passage IS NOT NULL").groupBy("item_id").agg(F.max("passage").alias("passage")).orderBy("item_id").collect()
    return [[(r[0], r[1]) for r in rows[k : k + size]] for k in range(0, len(rows), size)]


def leaks(documents: DataFrame, items: DataFrame, slots: bool = True) -> DataFrame:
    """(doc_id, item_id, words, changed, slots): every document and item where the document holds the passage or a stretch of it.

    changed: words of the stretch that differ; slots: those of them that are slots filled anew, one value for another all along. ``slots=False`` leaves
    placeholders and slots out.
    """
    sc = documents.sparkSession.sparkContext
    d = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "medium", "title")
    schema = "doc_id long, item_id long, words int, changed int, slots int"
    blocks = blocks_of(items)
    vocabulary = Vocabulary.of([p for b in blocks for _, p in b], slots=slots)
    out = None
    for k in range(0, len(blocks), BLOCKS_A_SCAN):
        shared = sc.broadcast((vocabulary, blocks[k : k + BLOCKS_A_SCAN]))

        def make(shared=shared):
            voc, several = shared.value
            indexes = [Index(b, vocabulary=voc, slots=slots) for b in several]

            def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
                for i, t, medium, title in rows:
                    w = words(t, medium, title)
                    for index in indexes:
                        for x in index.search(w):
                            yield i, *x

            return fn

        part = map_rows(d, make, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], schema)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p9_found: documents with the items they leak."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()

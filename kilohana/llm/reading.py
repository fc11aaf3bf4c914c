"""Problem 10: the reading grade of a document.

Every sentence is classified: a softmax model, L2-regularised, over hashed character n-grams and words (averaged over the sentence) and a few measures of
its form gives the distribution of its grade. A document's distribution is the mean over its sentences; a ridge regression on it and on the documents'
form, fitted to grades held out from the sentence models (cross-fitting), gives the difficulty, and cut points that fit the labels best turn it into a grade.
Hawaiian and English have a model each.

Labels: raters differ in how often they err by a grade, so a document's grade is the mode of a posterior in which each rater's error rate is estimated from
all labels together (a few rounds of expectation and maximisation). Training documents: those with labels, at most about ``TRAIN_DOCS`` (a hash picks them).

``grades`` gives every document a row, with a null grade and its reason where there is none: null texts, texts without a sentence of three words, languages
without labels. Scans are graded as rebuilt paragraphs; transcripts have no sentences and are cut into units of the labelled sentences' mean length, so
length speaks neither way. Where several languages with labels stand in a document, each part is graded and the mean weighted by letters. ``found`` keeps
typed documents of ``MIN_WORDS`` words in one language. Ties go to the lower grade. Repeated label rows count once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid, scans
from .base import canon_lang, map_rows
from .segment import Segmenter

GRADES, DIM, TRAIN_DOCS, MIN_WORDS, FOLDS = 6, 8192, 2000, 80, 3
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|ʻ(?=[^\W\d_]))*")
#: Folds of small letters, one quick replacement each.
_PLAIN = [*zip("āēīōū", "aeiou"), *((c, "") for c in "ʻ‘’'`ʼʽ")]
CLAUSE = {
    "haw": re.compile(r"\b(?:aka|oiai|a laila|no ka mea|eia nae|i mea e maopopo ai|i ka wa|a)\b"),
    "en": re.compile(r"\b(?:but|while|because|when|whereas|although|so that|and|if|which|that)\b"),
}
FORM = 6


def plain(text: str) -> str:
    """Small letters without macrons and okina."""
    text = text.lower()
    if not text.isascii() or "'" in text or "`" in text:
        for a, b in _PLAIN:
            text = text.replace(a, b)
    return text


def tokens(sentence: str) -> list[str]:
    return WORD.findall(plain(sentence))


def form(words: list[str], sentence: str, lang: str) -> list[float]:
    """Measures of a sentence's form."""
    n = len(words)
    flat = " ".join(words)
    return [math.log(n), n / 20, sentence.count(",") / 2, len(CLAUSE[lang].findall(flat)) / 2, (len(flat) - n + 1) / n / 5, sum([len(w) > 8 for w in words]) / n * 5]


class Hasher:
    """Hashed character n-grams and the word itself, kept per word."""

    def __init__(self) -> None:
        self.kept: dict[str, np.ndarray] = {}

    def of(self, w: str) -> np.ndarray:
        g = self.kept.get(w)
        if g is None:
            b = f"<{w}>"
            grams = [b, b] + [b[i : i + n] for n in (3, 4) for i in range(len(b) - n + 1)]
            g = np.array([zlib.crc32(x.encode()) % DIM for x in grams], dtype=np.intp)
            if len(self.kept) > 200_000:
                self.kept.clear()
            self.kept[w] = g
        return g


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class SentenceModel:
    w: np.ndarray  # DIM x GRADES, per gram of a word's mean
    v: np.ndarray  # FORM x GRADES
    b: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def word_vector(self, g: np.ndarray) -> np.ndarray:
        return self.w[g].sum(axis=0) / np.sqrt(len(g))


class Bags:
    """Sentences as word numbers, and words as gram numbers: gradients go from sentences to words, then to grams."""

    def __init__(self, sentences: list[list[str]], hasher: Hasher) -> None:
        ids: dict[str, int] = {}
        self.word = np.array([ids.setdefault(w, len(ids)) for s in sentences for w in s], dtype=np.intp)
        size = np.array([len(s) for s in sentences])
        self.size, self.start = size, np.concatenate([[0], np.cumsum(size)[:-1]])
        grams = [hasher.of(w) for w in ids]
        self.gram_size = np.array([len(g) for g in grams])
        self.gram = np.concatenate(grams)
        self.gram_start = np.concatenate([[0], np.cumsum(self.gram_size)[:-1]])

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, sentence of each, first place of each sentence) of chosen sentences."""
        size = self.size[k]
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(size.sum()) - np.repeat(start, size) + np.repeat(self.start[k], size)
        return self.word[at], np.repeat(np.arange(len(k)), size), start


def _fit_sentences(bags: Bags, keep: np.ndarray, forms: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, l2: float = 2e-4) -> SentenceModel:
    """Softmax regression of the kept sentences by full-batch Adam."""
    mean, sd = forms.mean(axis=0), forms.std(axis=0) + 1e-6
    f = (forms - mean) / sd
    word, row, start = bags.take(keep)
    size = bags.size[keep][:, None]
    root = np.sqrt(bags.gram_size)[:, None]
    of_gram = np.repeat(np.arange(len(bags.gram_size)), bags.gram_size)
    w, v, b = np.zeros((DIM, GRADES)), np.zeros((FORM, GRADES)), np.zeros(GRADES)
    target = np.zeros((len(y), GRADES))
    target[np.arange(len(y)), y] = 1
    m = [np.zeros_like(x) for x in (w, v, b)]
    s = [np.zeros_like(x) for x in (w, v, b)]
    for t in range(1, rounds + 1):
        vec = np.add.reduceat(w[bags.gram], bags.gram_start, axis=0) / root
        z = np.add.reduceat(vec[word], start, axis=0) / size + f @ v + b
        g = (_softmax(z) - target) * weight[:, None] / weight.sum()
        gs = g / size
        per_word = np.stack([np.bincount(word, weights=gs[row, k], minlength=len(root)) for k in range(GRADES)], axis=1) / root
        gw = np.stack([np.bincount(bags.gram, weights=per_word[of_gram, k], minlength=DIM) for k in range(GRADES)], axis=1) + l2 * w
        for k, (x, d) in enumerate(((w, gw), (v, f.T @ g + l2 * v), (b, g.sum(axis=0)))):
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.99 * s[k] + 0.01 * d * d
            x -= 0.15 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    return SentenceModel(w, v, b, mean, sd)


@dataclass
class Model:
    sentence: SentenceModel
    beta: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    cuts: np.ndarray


def consensus(labels: dict[int, list[tuple[str, int]]], rounds: int = 10) -> dict[int, int]:
    """Each document's most likely grade, with each rater's rate of one-grade errors estimated from all labels."""
    raters = sorted({r for v in labels.values() for r, _ in v})
    err = dict.fromkeys(raters, 0.2)
    post: dict[int, np.ndarray] = {}
    grades = np.arange(1, GRADES + 1)
    for _ in range(rounds):
        miss, total = dict.fromkeys(raters, 1.0), dict.fromkeys(raters, 5.0)
        for d, v in labels.items():
            p = np.ones(GRADES)
            for r, g in v:
                gap = abs(grades - g)
                p = p * np.where(gap == 0, 1 - err[r], np.where(gap == 1, err[r] / 2, 1e-3))
            post[d] = p / p.sum()
            for r, g in v:
                miss[r] += 1 - post[d][g - 1]
                total[r] += 1
        err = {r: min(0.6, max(0.02, miss[r] / total[r])) for r in raters}
    return {d: int(p.argmax()) + 1 for d, p in post.items()}


def _prepare(text: str, lang: str, seg: Segmenter) -> list[tuple[list[str], list[float]]]:
    out = []
    units = [u for _, _, u in seg.units(text, lang)]
    # Units hold no line break, so all are folded at once.
    for u, p in zip(units, plain("\n".join(units)).split("\n")):
        w = WORD.findall(p)
        if len(w) >= 3:
            out.append((w, form(w, u, lang)))
    return out


def _document_features(p: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """What the calibration sees: the mean distribution, its cumulated form, quantiles of the sentences' expected grades, mean form."""
    e = p @ np.arange(1, GRADES + 1)
    return np.concatenate([p.mean(axis=0), np.log(p.mean(axis=0) + 0.02), [e.mean(), np.median(e), e.std(), *np.quantile(e, [0.25, 0.75])], forms.mean(axis=0), forms.std(axis=0)])


class WordVectors:
    """Word vectors of a model, kept from sentence to sentence as rows of one array."""

    MOST = 300_000

    def __init__(self, m: SentenceModel, hasher: Hasher) -> None:
        self.m, self.hasher = m, hasher
        self.row: dict[str, int] = {}
        self.rows = np.empty((4096, GRADES))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.row) > self.MOST:
            self.row.clear()
        get = self.row.get
        at = np.array([k if (k := get(w)) is not None else self._add(w) for w in words], dtype=np.intp)
        return self.rows[at]

    def _add(self, w: str) -> int:
        k = self.row[w] = len(self.row)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[k] = self.m.word_vector(self.hasher.of(w))
        return k


def _probabilities(m: SentenceModel, sents: list, kept: WordVectors) -> tuple[np.ndarray, np.ndarray]:
    """(distribution of each sentence, forms)."""
    forms = np.array([f for _, f in sents])
    flat: list[str] = []
    for words, _ in sents:
        flat += words
    size = np.array([len(words) for words, _ in sents])
    z = np.add.reduceat(kept.of(flat), np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None]
    return _softmax(z + ((forms - m.mean) / m.sd) @ m.v + m.b), forms


def _fit_language(docs: list[list], grade: np.ndarray) -> Model:
    hasher = Hasher()
    owner = np.array([d for d, sents in enumerate(docs) for _ in sents])
    forms = np.array([f for sents in docs for _, f in sents])
    bags = Bags([w for sents in docs for w, _ in sents], hasher)
    y = grade[owner] - 1
    weight = 1.0 / np.bincount(owner, minlength=len(docs))[owner]
    fold = np.arange(len(docs)) % FOLDS

    def sentence_model(keep: np.ndarray) -> SentenceModel:
        k = np.flatnonzero(keep[owner])
        return _fit_sentences(bags, k, forms[k], y[k], weight[k])

    x = np.zeros((len(docs), len(_document_features(np.full((1, GRADES), 1 / GRADES), np.zeros((1, FORM))))))
    for j in range(FOLDS):
        if len(docs) < 2 * FOLDS:
            break
        m = sentence_model(fold != j)
        kept = WordVectors(m, hasher)
        for d in np.flatnonzero(fold == j):
            x[d] = _document_features(*_probabilities(m, docs[d], kept))
    whole = sentence_model(np.ones(len(docs), bool))
    if len(docs) < 2 * FOLDS:
        kept = WordVectors(whole, hasher)
        for d in range(len(docs)):
            x[d] = _document_features(*_probabilities(whole, docs[d], kept))
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    reg = np.eye(z.shape[1]) * 3.0
    reg[0, 0] = 0
    # Held-out difficulties for the cut points, all documents for the weights.
    out = np.zeros(len(docs))
    for j in range(FOLDS):
        a, b = (fold != j, fold == j) if len(docs) >= 2 * FOLDS else (np.ones(len(docs), bool),) * 2
        out[b] = z[b] @ np.linalg.solve(z[a].T @ z[a] + reg, z[a].T @ grade[a])
    beta = np.linalg.solve(z.T @ z + reg, z.T @ grade)
    cuts = []
    for g in range(1, GRADES):
        tries = np.linspace(g + 0.1, g + 0.9, 33)
        wrong = [int(((out > c) != (grade > g)).sum()) for c in tries]
        ok = [c for c, n in zip(tries, wrong) if n == min(wrong)]
        cuts.append(ok[len(ok) // 2])
    return Model(whole, beta, mean, sd, np.maximum.accumulate(np.array(cuts)))


def fit(rows: list[tuple[int, str, str]], labels: dict[int, list[tuple[str, int]]]) -> dict[str, Model]:
    """Models by language from (doc_id, lang, text) and the labels."""
    grade = consensus(labels)
    seg = Segmenter()
    out = {}
    for lang in ("haw", "en"):
        docs, g = [], []
        for i, k, t in sorted(rows):
            if k == lang and i in grade:
                s = _prepare(t, lang, seg)
                if s:
                    docs.append(s)
                    g.append(grade[i])
        if len(set(g)) > 1:
            out[lang] = _fit_language(docs, np.array(g))
    return out


class Grader:
    """Grades texts with fitted models."""

    def __init__(self, models: dict[str, Model]) -> None:
        self.models = models
        self.seg = Segmenter()
        self.hasher = Hasher()
        self.kept = {k: WordVectors(m.sentence, self.hasher) for k, m in models.items()}

    def unit_words(self, lang: str) -> int:
        """Mean words of a labelled sentence."""
        return max(3, round(float(self.models[lang].sentence.mean[1]) * 20))

    def grade(self, text: str, lang: str) -> tuple[int, float] | None:
        """(grade, difficulty); None where the text has no sentences or its language no model."""
        m = self.models.get(lang)
        sents = _prepare(text, lang, self.seg) if m else None
        if not sents:
            return None
        x = _document_features(*_probabilities(m.sentence, sents, self.kept[lang]))
        d = float(m.beta[0] + ((x - m.mean) / m.sd) @ m.beta[1:])
        return int((d > m.cuts).sum()) + 1, min(GRADES + 0.5, max(0.5, d))


def one_language(parts: list[tuple[str, float]]) -> str | None:
    """The language of all paragraphs, where they agree; rejected paragraphs (too short, names only) don't speak."""
    names = {k for k, _ in parts if k != "und"}
    return names.pop() if len(names) == 1 else None


def train(documents: DataFrame, labels: DataFrame, lm: langid.Model, most: int = TRAIN_DOCS) -> dict[str, Model]:
    """Fit on at most about ``most`` labelled documents."""
    lab = labels.where(f"doc_id IS NOT NULL AND rater IS NOT NULL AND grade BETWEEN 1 AND {GRADES}").select("doc_id", "rater", "grade").distinct()
    n = lab.select(F.countDistinct("doc_id")).first()[0]
    if n > most:
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    by: dict[int, list[tuple[str, int]]] = {}
    for r in sorted(lab.collect()):
        by.setdefault(r[0], []).append((r[1], r[2]))
    ids = lab.select("doc_id").distinct()
    rows = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").collect()  # ids: bounded by `most`
    grams = langid.Grams()
    langs = []
    for i, t in rows:
        k = one_language(lm.classify(grams, [langid.segment_words(b) for b in langid.blocks(t, "typed")]))
        if k:
            langs.append((i, k, t))
    return fit(langs, by)


TIME_MARK = re.compile(r"\[\d\d:\d\d:\d\d\]")


def by_language(parts: list[tuple[str, str]], label: str | None) -> dict[str, str]:
    """The text of each language of (language, paragraph), most letters first; paragraphs that tell none go with the first, else with the label's."""
    weight: dict[str, int] = {}
    for k, b in parts:
        if k != "und":
            weight[k] = weight.get(k, 0) + langid.letters(b)
    order = sorted(weight, key=lambda k: (-weight[k], k)) or ([label] if label else [])
    return {k: "\n\n".join(b for x, b in parts if x == k or x == "und" and k == order[0]) for k in order}


def grade_document(grader: Grader, texts: dict[str, str], medium: str | None) -> tuple[str | None, int | None, float | None, str | None]:
    """(lang, grade, difficulty, reason) of a document from its texts by language: the mean of what can be graded, weighted by letters."""
    if not texts:
        return None, None, None, "no language told"
    main = next(iter(texts))
    got = []
    for k, t in texts.items():
        if k in grader.models:
            if medium == "oral":
                w, n = t.split(), grader.unit_words(k)
                t = "\n".join(" ".join(w[j : j + n]) for j in range(0, len(w), n))
            if r := grader.grade(t, k):
                got.append((max(1, langid.letters(t)), *r))
    if not got:
        return main, None, None, "no sentence of three words" if main in grader.models else "no labels in its language"
    if len(got) == 1:
        return main, got[0][1], got[0][2], None
    total = sum(n for n, _, _ in got)
    mean = sum(n * g for n, g, _ in got) / total
    return main, int(np.ceil(mean - 0.5)), sum(n * d for n, _, d in got) / total, None


def _graded(documents: DataFrame, labels: DataFrame, keep: str, min_words: int, whole: bool) -> DataFrame:
    """grades() of the kept rows; whole: every row, else only those of enough words in one language with a model."""
    lm = langid.train(documents)
    models = train(documents, labels, lm)
    shared = documents.sparkSession.sparkContext.broadcast((lm, models))

    def make():
        lm, models = shared.value
        grader, grams = Grader(models), langid.Grams()

        def flush(batch: list) -> Iterator[tuple]:
            got = iter(lm.classify(grams, [langid.segment_words(b) for *_, bs in batch for b in bs]))
            for i, t, medium, label, bs in batch:
                parts = [next(got) for _ in bs]
                lang = one_language(parts)
                if lang and medium != "oral":
                    r = grader.grade(t, lang) if lang in models else None
                    if r:
                        yield i, lang, r[0], r[1], None
                    elif whole:
                        yield i, lang, None, None, "no sentence of three words" if lang in models else "no labels in its language"
                elif whole:
                    yield i, *grade_document(grader, by_language([(k, b) for (k, _), b in zip(parts, bs)], canon_lang(label)), medium)

        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            batch, n = [], 0
            for i, t, medium, title, label in rows:
                if t is None or not t.strip():
                    if whole:
                        yield i, None, None, None, "no text"
                    continue
                if not whole and len(t.split()) < min_words:
                    continue
                if medium == "scan":
                    t = scans.rebuild(t, title, {})
                elif medium == "oral":
                    t = TIME_MARK.sub(" ", t)
                bs = langid.blocks(t, "oral" if medium == "oral" else "typed")
                batch.append((i, t, medium, label, bs))
                n += len(bs)
                if n >= langid.GROUP:
                    yield from flush(batch)
                    batch, n = [], 0
            yield from flush(batch)

        return fn

    d = documents.where("doc_id IS NOT NULL").where(keep).select("doc_id", "text", "medium", "title", "lang")
    return map_rows(d, make, "doc_id long, lang string, grade long, difficulty double, reason string")


def grades(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, grade, difficulty, reason) of every document; lang is the main language, reason says why there is no grade."""
    return _graded(documents, labels, "true", 0, True)


def found(documents: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """p10_found: the grade of each typed document of enough words in one of the two languages."""
    return _graded(documents, labels, "medium = 'typed' AND text IS NOT NULL", min_words, False).select("doc_id", "grade")

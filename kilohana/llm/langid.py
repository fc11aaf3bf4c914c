"""Problem 5: the language of documents, of their paragraphs and of sentence rows, with a confidence.

Nearest-centroid classification. A segment's words give character n-grams (1 to 4, with word ends) and the words themselves, hashed to ``DIM`` numbers,
weighted by inverse document frequency and normalised. Each language has up to ``CLUSTERS`` centroids from spherical k-means over its training segments;
a segment takes the language of the centroid with the largest cosine, and is rejected ("und") where that cosine is below ``MARGIN`` of what all but ``LOW`` of the windows
of as many words of the language's own segments reach, for cosines grow with a segment's length. Words that begin with a capital inside a sentence (names, titles) are left out while enough others remain.

Training: documents whose label names a language, shorter than ``TRAIN_BYTES``, at most about ``TRAIN_DOCS`` a language (a hash of the id picks them), cut into paragraphs; since labels
are wrong now and then, a paragraph is kept only where the nearest seed (common words of each language, fixed values) agrees with its label. The seeds
themselves are training segments too, so a language without documents still has a centroid. The model is a few hundred kilobytes whatever the corpus.

Null or empty texts, and texts without letters, get no language. An empty corpus leaves the seeds as the model. Ties go to the earlier language code.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import CONFUSABLE, INVISIBLE, LANG_NAMES, OKINA_MARKS, SPACES, URL, URL_HINT, WIDE, canon_lang, canon_lang_col, latest, map_rows

DIM, CLUSTERS, TRAIN_DOCS = 4096, 3, 120
#: Training documents are shorter than so many bytes.
TRAIN_BYTES = 20_000
#: Words of the windows on which the floors are calibrated, how many windows a language, the share of them that may lie lower, and the share of the cosine of the others that is the floor.
LENGTHS, WINDOWS, LOW, MARGIN = (1, 2, 4, 8, 16, 32, 64), 400, 0.02, 0.85
#: Segments that a language must have for its floors to be calibrated.
MIN_BODY = 10
LANGS = sorted(LANG_NAMES)

#: Common words of each language. Fixed values.
SEEDS = {
    "haw": "ka ke nā ua i o e ma me he no ʻo ʻia aku mai ana nei ai a akā ʻaʻole pēlā nō kēia kēlā mea hale kai wai lā pō keiki kupuna mākou lākou ʻoiai laila hele noho ʻike hana ʻōlelo kou koʻu aia wahi inā mau loa maikaʻi hou",
    "en": "the of and to in a is was that for it with as his on be at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three read share click log reply article friends family weekly letter mail rights reserved publisher permission reprinted page column appears edition list issues earlier register leave below receive",
    "pt": "o a os as de do da dos das em no na nos nas um uma e que com não para por se foi era ao pela pelo mais mas como quando muito também ele ela seu sua havia ontem porque deu casa terra dia noite água escola navio menino perto viu embora",
    "mi": "te ngā ki i he ko kei ka e ana kua kāore nā te mea engari whakahoki whare wai tamaiti rangatira kaiako ā rā pō whakarongo haere kōrero me o a tū noho rātou tātou ia tēnei tērā iwi whenua reo whānau hapori",
    "sm": "le o sa na ua e i ma ona ae peitai ina faʻalogo tama fale tusi aiga nuʻu aliʻi afioaga faiaoga toe leʻi loʻo mai atu lea lenei aso po vai laʻau malo moana nofo alu tala tele umi lagi fetu aʻoaʻoga",
    "ja": "は の を に で と も が した ました ていました そして 父 母 先生 子供 村 学校 手紙 本 です ます これ それ この その から まで する した日 です。 読みました 言いました",
    "zh": "的 了 在 一 是 不 這 那 我 你 他 她 們 和 有 到 說 看 昨天 今天 老師 孩子 學校 故事 許多 然後 因為 所以 但是 沒有 什麼 可以 已經",
}

_FOLD = {ord(k): v for k, v in {**WIDE, **CONFUSABLE, **{s: " " for s in SPACES}}.items()}
_FOLD |= {ord(c): None for c in INVISIBLE} | {ord(c): "ʻ" for c in OKINA_MARKS} | {0x304: None}
_FOLD |= dict(zip(map(ord, "āēīōūĀĒĪŌŪ"), "aeiouAEIOU"))
_ODD = re.compile(r"[^\x00-\x7fʻ“”…—–]+")
#: The folds that come in nearly every text, one quick replacement each.
_OFTEN = [*zip("āēīōūĀĒĪŌŪ", "aeiouAEIOU"), ("‘", "ʻ"), ("’", "ʻ")]
_SEEN: dict[str, str] = {}


def _fold_run(m: re.Match) -> str:
    r = m.group()
    f = _SEEN.get(r)
    if f is None:
        f = r.translate(_FOLD)
        if len(r) < 4 and len(_SEEN) < 50_000:
            _SEEN[r] = f
    return f


KANA = r"぀-ヿｦ-ﾟ"
HAN = r"㐀-鿿豈-﫿"
WORD = re.compile(rf"[{KANA}{HAN}]|[^\W\d_{KANA}{HAN}](?:[^\W\d_{KANA}{HAN}]|ʻ(?=[^\W\d_]))*|ʻ[^\W\d_{KANA}{HAN}](?:[^\W\d_{KANA}{HAN}]|ʻ(?=[^\W\d_]))*")
LETTER = re.compile(r"[^\W\d_]+")
TIME_MARK = re.compile(r"\[\d\d:\d\d:\d\d\]")
#: A capitalised word that does not open a sentence or a quotation.
INNER_NAME = re.compile(r"(?<=[^\s.!?…:“\"'(\[»•])(\s+)(?:ʻ?[A-ZÀ-Þ][^\s.,!?…;:”\")\]]*)")


class Grams:
    """Hashed n-grams of words, kept per word."""

    MOST = 200_000

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self.kept: dict[str, np.ndarray] = {}

    def of(self, word: str) -> np.ndarray:
        g = self.kept.get(word)
        if g is None:
            if len(word) == 1 and ord(word) > 0x2E80:
                kind = "\1kana" if "぀" <= word <= "ヿ" else "\1han"
                grams = [kind, kind, word]
            else:
                w = f"<{word}>"
                grams = [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
                grams += [w, w, w] if len(word) < 6 else [w]
            g = np.array([zlib.crc32(x.encode()) % self.dim for x in grams], dtype=np.intp)
            if len(self.kept) >= self.MOST:
                self.kept.clear()
            self.kept[word] = g
        return g

    def counts(self, words: list[str]) -> np.ndarray:
        of = self.kept.get
        return np.bincount(np.concatenate([of(w) if w in self.kept else self.of(w) for w in words]), minlength=self.dim)


def segment_words(text: str) -> list[str]:
    """The words a segment is judged by."""
    if not text.isascii():
        for a, b in _OFTEN:
            text = text.replace(a, b)
        if _ODD.search(text):
            text = _ODD.sub(_fold_run, text)
    if "[0" in text:
        text = TIME_MARK.sub(" ", text)
    if URL_HINT.search(text):
        text = URL.sub(" ", text)
    bare = INNER_NAME.sub(r"\1", text)
    w = WORD.findall(bare.lower())
    if len(w) < 3:
        w = WORD.findall(text.lower())
    return w


def letters(text: str) -> int:
    return sum(map(len, LETTER.findall(text)))


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    lang_of: list[str]
    floor: np.ndarray  # languages x LENGTHS

    def floors(self, langs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The least cosine borne, by language and number of words, between the calibrated lengths in proportion to the words' logarithm."""
        x = np.minimum(np.log2(np.maximum(sizes, 1)), len(LENGTHS) - 1.0)
        lo = np.minimum(x.astype(int), len(LENGTHS) - 2)
        part = x - lo
        return self.floor[langs, lo] * (1 - part) + self.floor[langs, lo + 1] * part

    def classify(self, grams: Grams, segments: list[list[str]]) -> list[tuple[str, float]]:
        """(language or und, confidence) of each segment's words."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(segments)
        todo = [k for k, s in enumerate(segments) if s]
        names = self.lang_of
        owner = np.array([LANGS.index(x) for x in names])
        for a in range(0, len(todo), 256):
            part = todo[a : a + 256]
            v = np.empty((len(part), grams.dim), dtype=np.float32)
            for r, k in enumerate(part):
                v[r] = grams.counts(segments[k])
            v *= self.idf
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            cos = (v @ self.centroids.T) / np.maximum(norm, 1e-9)[:, None]
            by = np.full((len(part), len(LANGS)), -1.0, dtype=np.float32)
            for j, o in enumerate(owner):
                np.maximum(by[:, o], cos[:, j], out=by[:, o])
            best = cos.argmax(axis=1)
            ranked = np.sort(by, axis=1)
            floor = self.floors(owner[best], np.array([len(segments[k]) for k in part]))
            for r, k in enumerate(part):
                top, second = float(ranked[r, -1]), max(0.0, float(ranked[r, -2]))
                j = int(best[r])
                if top < floor[r]:
                    out[k] = ("und", max(0.0, 1 - top))
                else:
                    out[k] = (names[j], min(1.0, 0.5 + (top - second) / max(top, 1e-9) / 2))
        return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-9)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, first centre the mean's nearest, the next the farthest from those before."""
    c = [x[int((x @ x.mean(axis=0)).argmax())]]
    while len(c) < min(k, len(x)):
        far = np.max(np.stack([x @ y for y in c]), axis=0)
        c.append(x[int(far.argmin())])
    cen = np.stack(c)
    for _ in range(rounds):
        who = (x @ cen.T).argmax(axis=1)
        new = np.stack([x[who == j].mean(axis=0) if (who == j).any() else cen[j] for j in range(len(cen))])
        new = _unit(new)
        if np.allclose(new, cen, atol=1e-6):
            break
        cen = new
    return cen


def fit(samples: list[tuple[str, str]], clusters: int = CLUSTERS) -> Model:
    """A model from (language, segment) pairs; wrong labels are borne."""
    grams = Grams()
    seed_words = {k: segment_words(v) for k, v in SEEDS.items()}
    rows, tags, said = [], [], []
    for lang, seg in samples:
        w = segment_words(seg)
        if len(w) >= 4:
            said.append(w)
            rows.append(grams.counts(w).astype(np.float32))
            tags.append(lang)
    # Seeds in pieces of a dozen words, as if they were short segments.
    pieces = [(k, grams.counts(w[i : i + 12]).astype(np.float32)) for k, w in seed_words.items() for i in range(0, len(w), 12)]
    every = np.stack(rows + [p for _, p in pieces])
    df = (every > 0).sum(axis=0)
    idf = (np.log((1 + len(every)) / (1 + df)) + 0.3).astype(np.float32)
    seeds = _unit(np.stack([grams.counts(seed_words[k]) for k in LANGS]).astype(np.float32) * idf)
    x = _unit(every * idf)
    near = (x @ seeds.T).argmax(axis=1)
    tags = tags + [k for k, _ in pieces]
    own = [np.array([i for i in range(len(tags)) if tags[i] == k and (near[i] == n or i >= len(rows))], dtype=int) for n, k in enumerate(LANGS)]
    cen, lang_of = [], []
    for n, k in enumerate(LANGS):
        body = x[[i for i in own[n] if i < len(rows)]] if any(i < len(rows) for i in own[n]) else x[own[n]]
        for c in _kmeans(body, clusters):
            cen.append(c)
            lang_of.append(k)
        cen.append(_unit(x[[i for i in own[n] if i >= len(rows)]].mean(axis=0, keepdims=True))[0])
        lang_of.append(k)
    c = np.stack(cen).astype(np.float32)
    floor = np.zeros((len(LANGS), len(LENGTHS)), dtype=np.float32)
    for n, k in enumerate(LANGS):
        mine = c[[j for j, x in enumerate(lang_of) if x == k]]
        body = [said[i] for i in own[n] if i < len(rows)]
        for j, size in enumerate(LENGTHS):
            # Windows of the language's own segments, dealt over them evenly; short ones of the seeds where it has no segments.
            long = [w for w in body if len(w) >= size]
            if len(long) < MIN_BODY:
                floor[n, j] = floor[n, j - 1] if j and len(body) >= MIN_BODY else 0.05
                continue
            low = []
            for i in range(WINDOWS):
                w = long[i * len(long) // WINDOWS] if len(long) > WINDOWS else long[i % len(long)]
                at = (i * 7919) % (len(w) - size + 1)
                v = grams.counts(w[at : at + size]) * idf
                low.append(float((mine @ v).max() / max(1e-9, np.linalg.norm(v))))
            floor[n, j] = MARGIN * float(np.quantile(low, LOW))
    return Model(idf, c, lang_of, np.maximum.accumulate(floor, axis=1))


def train(documents: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on a bounded sample of labelled documents: about ``most`` a language, picked by a hash of the id."""
    lab = documents.select("doc_id", canon_lang_col(F.col("lang")).alias("l"), "text").where("l IS NOT NULL AND text IS NOT NULL AND octet_length(text) < " + str(TRAIN_BYTES))
    n = {r["l"]: r["n"] for r in lab.groupBy("l").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0)
    for k, v in n.items():
        part = F.when(F.col("l") == k, F.lit(int(min(1.0, most / v) * 1_000_000))).otherwise(part)
    rows = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part).select("l", "text", "doc_id").collect()
    return fit([(r["l"], p) for r in sorted(rows, key=lambda r: (r["l"], r["doc_id"], r["text"])) for p in re.split(r"\n\s*\n", r["text"]) if p.strip()])


def blocks(text: str, medium: str | None) -> list[str]:
    """Segments of a document: paragraphs of typed text, else runs of lines or words of about 400 characters."""
    if medium == "typed":
        return re.split(r"\n[^\S\n]*\n\s*", text.strip("\n")) if text.strip() else []
    out, cur, n = [], [], 0
    for piece in text.split("\n") if "\n" in text else re.findall(r"\S+\s*", text):
        cur.append(piece)
        n += len(piece)
        if n >= 400:
            out.append("\n".join(cur) if "\n" in text else "".join(cur))
            cur, n = [], 0
    if cur:
        out.append("\n".join(cur) if "\n" in text else "".join(cur))
    return out


SCHEMA = "rec_id long, seg_no long, lang string, confidence double, main string, label string, medium string"
GROUP = 400


def label_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(rec_id, seg_no, lang, confidence, main, label, medium): seg_no 0 is the document by its main language, the others its paragraphs."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m, grams = shared.value, Grams()

        def flush(batch: list) -> Iterator[tuple]:
            segs = [segment_words(b) for *_, bs in batch for b in bs]
            got = iter(m.classify(grams, segs))
            for i, lang, medium, bs in batch:
                res = [next(got) for _ in bs]
                weight: dict[str, float] = {}
                conf: dict[str, float] = {}
                for b, (k, c) in zip(bs, res):
                    if k != "und":
                        n = letters(b)
                        weight[k] = weight.get(k, 0) + n
                        conf[k] = conf.get(k, 0) + n * c
                main = max(sorted(weight), key=lambda k: weight[k]) if weight else None
                yield i, 0, main, conf[main] / sum(weight.values()) if main and sum(weight.values()) else 0.0, main, canon_lang(lang), medium
                if medium == "typed":
                    for n, (k, c) in enumerate(res, 1):
                        yield i, n, k, c, main, None, medium

        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            batch, n = [], 0
            for i, lang, medium, text in rows:
                if not text:
                    continue
                bs = blocks(text, medium)
                batch.append((i, lang, medium, bs))
                n += len(bs)
                if n >= GROUP:
                    yield from flush(batch)
                    batch, n = [], 0
            yield from flush(batch)

        return fn

    return map_rows(documents.where("doc_id IS NOT NULL").select("doc_id", "lang", "medium", "text"), make, SCHEMA)


def label_sentences(sentences: DataFrame, model: Model) -> DataFrame:
    """(rec_id, created, lang, confidence, letters) of every sentence row delivered."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    def make():
        m, grams = shared.value, Grams()

        def flush(batch: list) -> Iterator[tuple]:
            for (i, created, n, _), (k, c) in zip(batch, m.classify(grams, [w for *_, w in batch])):
                yield i, created, k, c, n

        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            batch = []
            for i, created, text in rows:
                text = text or ""
                batch.append((i, created, letters(text), segment_words(text)))
                if len(batch) >= GROUP:
                    yield from flush(batch)
                    batch = []
            yield from flush(batch)

        return fn

    return map_rows(sentences.where("sentenceid IS NOT NULL").select("sentenceid", "created", "hawaiiantext"), make, "rec_id long, created timestamp_ntz, lang string, confidence double, letters int")


def languages(documents: DataFrame, sentences: DataFrame, model: Model | None = None) -> DataFrame:
    """(rec_table, rec_id, seg_no, lang, confidence) of every document, paragraph and sentence row; lang is null where it is rejected."""
    model = model or train(documents)
    d = label_documents(documents, model).select(F.lit("documents").alias("rec_table"), "rec_id", "seg_no", F.expr("nullif(lang, 'und')").alias("lang"), "confidence")
    s = latest(label_sentences(sentences, model), "rec_id", "lang", "confidence")
    s = s.select(F.lit("sentences").alias("rec_table"), "rec_id", F.lit(0).cast("long").alias("seg_no"), F.expr("nullif(lang, 'und')").alias("lang"), "confidence")
    return d.unionByName(s)


def found(documents: DataFrame, sentences: DataFrame, model: Model | None = None) -> DataFrame:
    """p5_found: wrong or missing labels, paragraphs in another language, sentence rows that are not Hawaiian."""
    model = model or train(documents)
    d = label_documents(documents, model).where("lang IS NOT NULL AND lang <> 'und'")
    d = d.where("(seg_no = 0 AND (label IS NULL OR label <> main)) OR (seg_no > 0 AND medium = 'typed' AND lang <> main)")
    d = d.select(F.lit("documents").alias("rec_table"), "rec_id", "seg_no", "lang")
    s = latest(label_sentences(sentences, model), "rec_id", "lang", "letters").where("letters >= 20 AND lang <> 'und' AND lang <> 'haw'")
    s = s.select(F.lit("sentences").alias("rec_table"), "rec_id", F.lit(0).cast("long").alias("seg_no"), "lang")
    return d.unionByName(s)

"""Problem 7: the main body of a page.

Composite text density: every DOM node gets its characters per tag, corrected by the share of link text; each node's sum of its children's densities is
taken; the node with the largest sum is selected, and so is the node with the largest sum of every other branch that is as dense as the threshold, the least
density on the path from the first one to <body>. Siblings of one class stem, and the semantic containers nav, aside, header and footer, count as nodes of
their own. A page that has neither is flat (its nesting is only what unclosed tags leave): its blocks are children of the body, and the run of blocks
with the largest sum of densities above ``FLAT`` of the body's mean is selected. A page without html is read as a flat one with a block for each line.

Lines that density can't tell from the story, since they stand in the same container (bylines, dates, prompts, related titles with their teasers, comments),
then leave by cue, in order of the lines; the headline is the page's title standing alone.

Null text gives no lines; null html falls back to the text; a page delivered twice counts once, the last one; empty pages have no body.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import latest, map_rows

TAG = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^>]*)>", re.S | re.I)
CLASS = re.compile(r"class\s*=\s*[\"']?\s*([A-Za-z]+)")
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td th thead tr ul".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
#: A new one of these ends an open one of the same kind.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
OUTSIDE = {"nav", "aside", "footer", "header", "form"}
SEMANTIC = {"nav", "aside", "footer", "article", "main"}
WS = re.compile(r"\s+")
#: Of a flat page's mean block density, what a block must exceed to add to the run.
FLAT = 0.15


class Page:
    """Blocks of text in document order with their nodes."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag = [-1], ["#root"]
        self.chars, self.tags, self.link, self.link_tags = [0.0], [0], [0.0], [0]
        self.blocks: list[tuple[str, int, float]] = []  # text, node, link share
        self.title = ""
        self._parse(source)

    @classmethod
    def of_lines(cls, lines: list[str]) -> Page:
        """A flat page with a block for each line."""
        page = cls("")
        page.blocks = [(t, 0, 0.0) for t in (WS.sub(" ", x).strip() for x in lines) if t]
        page.chars[0] = float(sum(len(t) for t, *_ in page.blocks))
        return page

    def _node(self, tag: str, parent: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        for a in (self.chars, self.link):
            a.append(0.0)
        for b in (self.tags, self.link_tags):
            b.append(0)
        self.tags[-1] = 1
        return len(self.parent) - 1

    def _parse(self, s: str) -> None:
        stack = [(0, "#root")]
        stems: dict[tuple[int, str], int] = {}
        buf: list[str] = []
        in_link = link_chars = 0
        in_title = False

        def flush() -> None:
            nonlocal link_chars
            if buf:
                t = WS.sub(" ", _html.unescape("".join(buf))).strip()
                if t:
                    n = stack[-1][0]
                    self.blocks.append((t, n, min(1.0, link_chars / max(1, len(t)))))
                    self.chars[n] += len(t)
                    self.link[n] += min(link_chars, len(t))
                buf.clear()
            link_chars = 0

        at = 0
        for m in TAG.finditer(s):
            if m.start() > at:
                piece = s[at : m.start()]
                if in_title:
                    self.title += piece
                else:
                    buf.append(piece)
                    if in_link:
                        link_chars += len(WS.sub(" ", _html.unescape(piece)).strip())
            at = m.end()
            name = (m.group(3) or "").lower()
            if not name:
                continue
            if name == "title":
                in_title = not m.group(2)
                continue
            if name == "br":
                flush()
                self.tags[stack[-1][0]] += 1
                continue
            if m.group(2):
                if name == "a":
                    in_link = max(0, in_link - 1)
                if name in BLOCK:
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == name:
                        del stack[k:]
                        break
                continue
            if name == "a":
                in_link += 1
                self.link_tags[stack[-1][0]] += 1
            if name not in BLOCK:
                self.tags[stack[-1][0]] += 1
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in SELF_CLOSING.get(name, ()):
                    del stack[k:]
                    break
                if stack[k][1] in ("table", "ul", "ol", "dl", "article", "body"):
                    break
            parent = stack[-1][0]
            c = CLASS.search(m.group(4) or "")
            if c:  # siblings of one class stem share a section
                key = (parent, c.group(1).lower())
                parent = stems.setdefault(key, -1)
                if parent < 0:
                    parent = stems[key] = self._node("." + key[1], key[0])
            n = self._node(name, parent)
            if name not in VOID:
                stack.append((n, name))
        if at < len(s):
            buf.append(s[at:])
        flush()
        self.title = WS.sub(" ", _html.unescape(self.title)).strip()

    def flat(self) -> bool:
        """Has the page neither sections nor semantic containers? Then nesting is only what unclosed tags leave, and its blocks are children of the body."""
        return not any(t.startswith(".") or t in SEMANTIC for t in self.tag)

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density of each node, and the sum over its children."""
        n = len(self.parent)
        c, t, lc, lt = self.chars[:], self.tags[:], self.link[:], self.link_tags[:]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            c[p] += c[i]
            t[p] += t[i]
            lc[p] += lc[i]
            lt[p] += lt[i]
        self.body = (max(1.0, c[0]), lc[0])
        d = [self._density(c[i], t[i], lc[i], lt[i]) for i in range(n)]
        total = [0.0] * n
        for i in range(1, n):
            total[self.parent[i]] += d[i]
        # Text of the node itself, cut by line breaks, counts as children too.
        for text, node, share in self.blocks:
            total[node] += len(text) * (1 - share) / 2
        return d, total

    def _density(self, c: float, t: float, lc: float, lt: float) -> float:
        """Characters per tag, corrected by the links in them and in the whole body."""
        if c <= 0:
            return 0.0
        cb, lcb = self.body
        base = math.log(c / max(1.0, c - lc) * lc + lcb / cb * c + math.e)
        top = math.log(max(1.0001, c / max(1.0, lc) * max(1, t) / max(1, lt)))
        return c / max(1, t) * top / base

    def selected(self, path: float = 1.0, flat: float = FLAT) -> list[bool]:
        """Of each block: does it stand in what the densities select?

        The node with the largest density sum is selected, and in every other branch as dense as the threshold, the least density on the path from the
        first one to the body, the node with the largest sum there; ``path`` scales the threshold. Of a flat page, whose blocks are all children of one
        node, the run of blocks with the largest sum of densities above the threshold is selected.
        """
        if not self.blocks:
            return []
        d, total = self.densities()
        n = len(self.parent)
        if self.flat():
            link = sum(share > 0 for *_, share in self.blocks)
            size = len(self.blocks)
            threshold = flat * self._density(self.body[0] / size, 1, self.body[1] / size, link / size)
            over = [self._density(len(t), 1, share * len(t), share > 0) - threshold for t, _, share in self.blocks]
            lo, hi = best_run(over)
            return [lo <= k < hi for k in range(len(over))]
        barred = [False] * n
        for i in range(1, n):
            barred[i] = barred[self.parent[i]] or self.tag[i] in OUTSIDE
        # Nodes are numbered parents first, so one pass from the end gives the best of every branch.
        top = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not barred[i] and (total[top[i]], -top[i]) > (total[top[p]], -top[p]):
                top[p] = top[i]
        best = top[0]
        threshold, up = d[best], best
        while self.parent[up] > 0:
            up = self.parent[up]
            threshold = min(threshold, d[up])
        inside = [False] * n
        inside[best] = True
        for i in range(1, n):
            if barred[i]:
                continue
            if inside[self.parent[i]]:
                inside[i] = True
            elif d[i] >= path * threshold and top[i] != best and total[top[i]] >= path * threshold:
                inside[top[i]] = True
        return [inside[node] and not barred[node] and share < 0.5 for _, node, share in self.blocks]


def best_run(over: list[float]) -> tuple[int, int]:
    """The run of numbers with the largest sum, (first, behind last); the earliest of equal ones."""
    best, lo, hi, cur, at = 0.0, 0, 0, 0.0, 0
    for k, x in enumerate(over):
        if cur <= 0:
            cur, at = 0.0, k
        cur += x
        if cur > best:
            best, lo, hi = cur, at, k + 1
    return lo, hi


# Cues, in the corpus languages and English. Fixed values.
RELATED = re.compile(r"^(?:related(?: (?:stories|posts|articles))?|read (?:also|more|next)|see also|most read|popular this week|trending|you may also like|e heluhelu pū|nā mea like|nā mea (?:hou|e aʻe)|heluhelu hou)\s*:?$", re.I)
INLINE = re.compile(r"^(?:see also|read (?:also|more|next)|related|e heluhelu pū|e nānā pū)\s*:?\s+\S", re.I)
TEASER = re.compile(r"(?:…|\.\.\.|\[more\]|\[…\]|heluhelu hou|read more|more ?»)\s*$", re.I)
COMMENTS = re.compile(r"^(?:\d+ comments?|comments? ?\(?\d*\)?|nā manaʻo ?\(\d+\)|leave a (?:reply|comment).*|log in .* reply.*)$", re.I)
COMMENT = re.compile(r"^[A-ZĀĒĪŌŪʻ][\wʻ'’-]{1,20}: \S")
PROMPT = re.compile(
    r"^e kākau inoa\b|cookies?\b|\bkuki\b|this site\b.*\b(?:accept|consent)|by staying on this page|privacy matters|manage preferences|newsletter|subscribe (?:to|now)|sign up|never miss|leka hebedoma|support our work|gift of any size|"
    r"^(?:story continues|continues below|print this page|share this|kaʻana i kēia|e kaʻana\b|like this page|tell your friends|advertisement|hoʻolaha|back to top|skip to)|\b(?:share|tweet|email|print)\b(?:\s*\|\s*\b(?:share|tweet|email|print)\b)+|ka hāʻawi makana",
    re.I,
)
FOOTER = re.compile(r"©|all rights reserved|nā kuleana a pau|powered by|back to top|terms of use|privacy \||accessibility|p\.o\. box|\(\d{3}\)\s*\d{3}-\d{3}|leka uila|@\w+\.\w+|hana ʻia me ke aloha|contact us:", re.I)
MONTH = r"(?:ianuali|pepeluali|malaki|ʻ?apelila|mei|iune|iulai|ʻ?aukake|kepakemapa|ʻ?okakopa|nowemapa|kekemapa|january|february|march|april|may|june|july|august|september|october|november|december|(?:jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\.?)"
DATELINE = re.compile(rf"^(?:updated|published|posted|hoʻopuka ʻia|paʻi ʻia|ua hoʻopuka ʻia)?\s*:?\s*(?:on |i ka lā )?(?:{MONTH}\s+\d{{1,2}}(?:,?\s+\d{{4}})?|\d{{1,2}}\s+(?:o\s+)?{MONTH},?\s+\d{{4}}|\d{{1,4}}[./-]\d{{1,2}}[./-]\d{{2,4}})(?:[,\s].{{0,14}})?$", re.I)
NAME = r"[A-ZĀĒĪŌŪʻ][\wʻ'’.-]*"
BYLINE = re.compile(rf"^(?:(?:[Bb]y|BY|Na|NA|Kākau ʻia e|Written by|Text by|Na ka)\s+(?:{NAME}(?:\s+(?:a me\s+|and\s+|&\s+)?{NAME}){{0,5}}|(?:ka\s+)?luna(?:\s\S+)?)|Kākau ʻia e ka luna\b.*|(?:ka luna|{NAME}(?:\s+{NAME}){{1,3}}), (?:luna kākau|editor|staff writer|ka mea kākau))$")
ENDED = re.compile(r"[.!?…。！？:,;][”\"’)\]」]*$")
CRUMB = re.compile(r"\s(?:>|/|»|›)\s")


def _fold(s: str) -> str:
    return WS.sub(" ", s).strip().casefold()


#: Words of a title at most.
TITLE_WORDS = 8


def title_shaped(s: str) -> bool:
    """Few words without a final mark that are all capitals or end in a capitalised word, as titles do and running text, verses and list entries seldom."""
    w = s.split()
    return 2 <= len(w) <= TITLE_WORDS and not ENDED.search(s) and (s.isupper() or w[-1].lstrip("ʻ‘“\"'(")[:1].isupper() and w[0][:1].isupper())


def _paragraph(s: str) -> bool:
    return len(s) >= 25 and bool(re.search(r"[.!?…。！？][”\"’)\]」]*$", s))


def read_lines(lines: list[str], mark: list[bool | None], title: str) -> list[bool]:
    """Which lines belong to the body. mark: what the page's density says of the line, None where html does not show it."""
    n = len(lines)
    t = _fold(title)
    kind = []
    for s, ok in zip(lines, mark):
        u = s.strip()
        if not u:
            kind.append("blank")
        elif FOOTER.search(u) and len(u) < 160 and not _paragraph_like(u):
            kind.append("footer")
        elif COMMENTS.match(u):
            kind.append("comments")
        elif RELATED.match(u):
            kind.append("related")
        elif INLINE.match(u) and len(u) < 110 and not ENDED.search(u):
            kind.append("prompt")
        elif PROMPT.search(u) and len(u) < 130 and (PROMPT.match(u) or not TEXTY.search(u)):
            kind.append("prompt")
        elif DATELINE.match(u):
            kind.append("date")
        elif BYLINE.match(u):
            kind.append("byline")
        elif u.count("|") >= 2 or CRUMB.search(u) and t and _fold(re.split(r"\s(?:>|/|»|›)\s", u)[-1]) == t:
            kind.append("menu")
        else:
            kind.append("text")
    # The headline: the page's title standing alone, outside a list of related titles; else the first line like a title, or the last of a list that opens the page.
    if not t:
        after = {_fold(x) for x in lines}
        for i in range(n):
            if CRUMB.search(lines[i]) and (c := _fold(re.split(r"\s(?:>|/|»|›)\s", lines[i].strip())[-1])) in after:
                t = c
                kind[i] = "menu"
                break
    first, state, head, listed = n, "", -1, -1
    own = own_listed = -1
    for i in range(n):
        k, u = kind[i], lines[i].strip()
        if k == "related":
            state = "related"
        elif k == "comments" and own >= 0:
            break
        elif k == "text":
            if state == "related" and TEASER.search(u) and mark[i] is not True:
                state = ""
                continue
            if _paragraph(u):
                if mark[i] is False:
                    continue
                first = i
                break
            if t and _fold(u) == t:
                if state == "related" and mark[i] is not True:
                    own_listed = i
                elif own < 0:
                    own = i
            elif title_shaped(u) and mark[i] is not False:
                if state == "related":
                    listed = i
                elif head < 0:
                    head = i
        elif k in ("byline", "date") and state == "related":
            state = ""
    head = next((x for x in (own, own_listed, head if not t else -1, listed if not t else -1) if x >= 0), -1)
    if head < 0 and first < n:
        for i in range(first - 1, -1, -1):
            if kind[i] == "text" and mark[i] is not False and not CRUMB.search(lines[i]):
                head = i
                break
            if kind[i] in ("related", "comments"):
                break
    keep = [False] * n
    if first == n and head < 0:
        return keep
    start = head if head >= 0 else first
    state, listed, shown = "", 0, False
    for i in range(start, n):
        k, u = kind[i], lines[i].strip()
        if k == "blank":
            continue
        if i == head:
            keep[i] = True
            continue
        if k == "footer":
            if i > first:
                state = "footer" if mark[i] is not True or state == "footer" else state
            continue
        if k == "comments":
            state = "comments"
            continue
        if k == "related":
            # Where the page's sections show the list, only lines they leave open can be part of it.
            state, listed, shown = "related", 0, mark[i] is False
            continue
        if k in ("prompt", "date", "byline", "menu"):
            if state == "related" and listed:
                state = ""
            continue
        if state == "comments" and COMMENT.match(u):
            continue
        if state == "comments" and mark[i] is not True:
            continue
        if state == "related":
            if mark[i] is False:
                continue
            if mark[i] is True or shown and not TEASER.search(u):
                state = ""
            elif TEASER.search(u):
                state = ""
                continue
            elif title_shaped(u):
                listed += 1
                continue
            else:
                state = ""
        if mark[i] is False:
            continue
        keep[i] = True
    return keep


TEXTY = re.compile(r"\b(?:i ka|o ka|ma ka|ka mea|the \w+ \w+ed)\b")


def _paragraph_like(s: str) -> bool:
    """Running text that only mentions an address or a right."""
    return len(s) > 60 and len(re.findall(r"\b(?:ka|ke|nā|i|ua|the|and|of|was)\b", s, re.I)) >= 5


def main_lines(html: str | None, text: str | None) -> list[int]:
    """1-based numbers of the lines of ``text`` that belong to the main body."""
    if not text:
        return []
    lines = text.split("\n")
    mark: list[bool | None] = [None] * len(lines)
    title = ""
    if html:
        page = Page(html)
        title = page.title
        heads = [b[0] for b in page.blocks if page.tag[b[1]] == "h1"]
        if heads:
            title = heads[0]
        elif " - " in title:
            title = title.rsplit(" - ", 1)[0]
        # Sections tell for and against a block; semantic containers and the run of a flat page only against it.
        sure = any(t.startswith(".") for t in page.tag)
    else:
        page, sure = Page.of_lines(lines), False
    marks = page.selected()
    first = marks.index(True) if page.flat() and True in marks else 0
    # Blocks and lines run in the same order; a line takes the mark of the next block with its text.
    at = 0
    where: dict[str, list[int]] = {}
    for k, (b, _, _) in enumerate(page.blocks):
        where.setdefault(b, []).append(k)
    for i, s in enumerate(lines):
        u = WS.sub(" ", s).strip()
        if not u:
            continue
        for k in where.get(u, ()):
            if k >= at:
                at = k + 1
                mark[i] = (True if sure else None) if marks[k] else False
                if not marks[k] and k < first and title_shaped(u):
                    mark[i] = None  # the headline stands before the run
                break
    return [i + 1 for i, k in enumerate(read_lines(lines, mark, title)) if k]


def body_lines(contents: DataFrame) -> DataFrame:
    """(sourceid, line_no) of the main body's lines."""

    def make():
        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            for i, created, h, t in rows:
                yield i, created, main_lines(h, t)

        return fn

    lines = map_rows(contents.where("sourceid IS NOT NULL AND text IS NOT NULL").select("sourceid", "created", "html", "text"), make, "sourceid long, created timestamp_ntz, lines array<int>")
    return latest(lines, "sourceid", "lines").select("sourceid", F.explode(F.col("lines").cast("array<bigint>")).alias("line_no"))


def found(contents: DataFrame) -> DataFrame:
    """p7_found: the lines of contents.text in the main body."""
    return body_lines(contents)


def bodies(contents: DataFrame) -> DataFrame:
    """(sourceid, body): each page's main body as text."""

    def make():
        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            for i, created, h, t in rows:
                if t is None and h is not None:
                    t = "\n".join(b[0] for b in Page(h).blocks)
                keep = main_lines(h, t)
                lines = (t or "").split("\n")
                yield i, created, "\n".join(lines[k - 1] for k in keep)

        return fn

    out = map_rows(contents.where("sourceid IS NOT NULL").select("sourceid", "created", "html", "text"), make, "sourceid long, created timestamp_ntz, body string")
    return latest(out, "sourceid", "body")

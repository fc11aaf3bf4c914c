"""Problem 6: cutting oversized items at natural boundaries.

Recursive bisection: a span above the limit is cut at the strongest boundary near its middle (paragraph, line, sentence, clause, word, character, in this
order), and each half that still exceeds the limit less the overlap is cut again. Every piece but the first then gets the last ``overlap`` bytes of the one
before in front, or the nearest whole character below. Sizes are UTF-8 bytes; the pieces without their overlaps give back the text, byte by byte.

A null text has no pieces, a text within the limit is one piece, an empty text is one empty piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import latest, map_rows

LIMIT, OVERLAP = 30_000, 500

#: Boundaries, strongest first; each match's end is a place to cut.
BOUNDARIES = [
    re.compile(rb"\n[ \t]*\n\s*"),
    re.compile(rb"\n"),
    re.compile(rb"(?:[.!?]|\xe2\x80\xa6)(?:\xe2\x80\x9d|[\"')\]])*\s+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)(?:\xe3\x80\x8d|\xe3\x80\x8f)*"),
    re.compile(rb"[,;:]\s+|\xe3\x80\x81|\xef\xbc\x8c"),
    re.compile(rb"\s+"),
]


def _char_down(b: bytes, i: int) -> int:
    """The nearest start of a character at or below i."""
    while i > 0 and i < len(b) and b[i] & 0xC0 == 0x80:
        i -= 1
    return i


def cuts(b: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Places to cut, in order, so that each piece with its overlap is at most ``limit`` bytes."""
    if limit <= overlap + 8:
        raise ValueError("the limit must exceed the overlap by more than a character")
    out: list[int] = []
    if len(b) <= limit:
        return out
    room = limit - overlap
    todo = [(0, len(b))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= room:
            continue
        mid = (lo + hi) // 2
        # Near the middle: within a quarter of the span either way, and not wider than lets the halves shrink.
        reach = max(1, min((hi - lo) // 4, room))
        a, z = max(lo + 1, mid - reach), min(hi - 1, mid + reach)
        cut = 0
        for rx in BOUNDARIES:
            best = None
            for m in rx.finditer(b, a, z):
                e = m.end()
                if lo < e < hi and e <= z and (best is None or abs(e - mid) < abs(best - mid)):
                    best = e
            if best is not None:
                cut = best
                break
        if not cut:
            cut = _char_down(b, mid)
            if cut <= lo:
                cut = mid
        out.append(cut)
        todo += [(lo, cut), (cut, hi)]
    return sorted(out)


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start byte, overlap bytes, piece): ``start`` is where the new part begins; the piece begins ``overlap bytes`` before it."""
    if text is None:
        return []
    b = text.encode("utf-8", "surrogatepass")
    at = [0, *cuts(b, limit, overlap), len(b)]
    out = []
    for i, (lo, hi) in enumerate(zip(at, at[1:])):
        # The last `overlap` bytes of the piece before, or the nearest whole character below: never more than `overlap` bytes.
        start = lo
        if i:
            start = max(0, lo - overlap)
            while start < lo and b[start] & 0xC0 == 0x80:
                start += 1
        out.append((lo, lo - start, b[start:hi].decode("utf-8", "surrogatepass")))
    return out


def oversized(df: DataFrame, text: str, limit: int = LIMIT) -> DataFrame:
    return df.where(F.octet_length(F.col(text)) > limit)


def split(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, start_byte, overlap_bytes, piece) of every text above the limit."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def make():
        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            for i, t in rows:
                for k, (lo, ov, p) in enumerate(pieces(t, limit, overlap), 1):
                    yield i, k, lo, ov, p

        return fn

    return map_rows(oversized(df.select(id_col, text_col), text_col, limit), make, f"`{id_col}` {types[id_col]}, piece_no int, start_byte long, overlap_bytes int, piece string")


def _both(documents: DataFrame, contents: DataFrame, limit: int = LIMIT) -> DataFrame:
    d = oversized(documents.where("doc_id IS NOT NULL"), "text", limit).select(F.lit("documents").alias("rec_table"), F.col("doc_id").alias("rec_id"), "text")
    # The last delivery decides, also where it is a short one; only oversized texts move.
    big = contents.withColumn("text", F.when(F.octet_length("text") > limit, F.col("text")))
    c = latest(big, "sourceid", "text").where("text IS NOT NULL").select(F.lit("contents").alias("rec_table"), F.col("sourceid").alias("rec_id"), "text")
    return d.unionByName(c)


def all_pieces(documents: DataFrame, contents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of all oversized documents and pages: (rec_table, rec_id, piece_no, start_byte, overlap_bytes, piece)."""

    def make():
        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            for tab, i, t in rows:
                for k, (lo, ov, p) in enumerate(pieces(t, limit, overlap), 1):
                    yield tab, i, k, lo, ov, p

        return fn

    return map_rows(_both(documents, contents, limit), make, "rec_table string, rec_id long, piece_no int, start_byte long, overlap_bytes int, piece string")


def found(documents: DataFrame, contents: DataFrame) -> DataFrame:
    """p6_found: the records that come out in more than one piece."""
    p = all_pieces(documents, contents).where("piece_no = 2")
    return p.select("rec_table", "rec_id")

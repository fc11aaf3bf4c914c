"""Problem 8: filling fixed-capacity containers with items.

Vector bin packing by the dot-product heuristic: an item has a size in each of several dimensions (tokens, segments, loss-bearing tokens), each measured
against the container's limit; a container is filled with the item whose sizes agree best (largest dot product) with the room that is left, among those
that fit in every dimension. Items with the same sizes are alike, so the heuristic runs on counts of size classes, not on rows: the work of a task depends
on the number of distinct sizes, not of items, and no group of items is ever held in one task.

Plan: (1) tokens are counted with a public tokenizer in Arrow batches; loss-bearing are all tokens but those of the prompt, the heading that opens a text, and
of time marks; only items above the capacity in tokens are cut, into pieces of the capacity (token spans); an item that has more loss-bearing tokens
than the limit keeps all its tokens, and the surplus at its head bears no loss; (2) the pieces are dealt to shards by a hash of their id, the number
of shards growing with the number of pieces (``PER_SHARD`` each), so a shard's packing is bounded, and each shard is a partition of its own; (3) each shard packs, the last containers of all shards that are filled below ``TOP_UP`` are packed once more
together, shard by shard in a smaller number of shards, so that little room is left at the seams; (4) every piece comes out with its container.

Null ids and null texts are no items; an empty text is an item of no tokens and one segment. Equal texts under other ids are items of their own. Ties go to
the smaller class and then the smaller id. An empty table gives no containers.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohana.session import cut_lineage

from .base import map_rows

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY, SEGMENTS, LOSS = 2048, 6, 2040
PER_SHARD, TOP_UP = 4_096, 0.97
#: A heading: the first line of several, without the mark that ends a sentence.
HEADING = re.compile(r"[^\n]*[^\n.!?…。！？”\"」』:;,\s][ \t]*\n(?=\s*\S)")
TIME_MARK = re.compile(r"\[\d\d:\d\d:\d\d\]")
#: The pattern that cuts text before merging, as published with the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """Counts tokens with a public byte-level vocabulary; long runs without spaces are fine."""

    def __init__(self, path: str = TOKENIZER) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("kilohana", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, texts: list[str]) -> list[int]:
        return [len(self.enc.encode_ordinary(t)) for t in texts]


def prompt_parts(text: str) -> list[str]:
    """The parts of a text that bear no loss: the heading that opens it, and time marks."""
    m = HEADING.match(text)
    return ([m.group()] if m else []) + (TIME_MARK.findall(text, m.end() if m else 0) if "[0" in text else [])


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens, n_loss): tokens of each text, and those that bear loss. The vocabulary file goes to the executors with the job."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    df.sparkSession.sparkContext.addFile(tokenizer)

    def make():
        from pyspark import SparkFiles

        enc = Tokens(SparkFiles.get(os.path.basename(tokenizer))).enc.encode_ordinary
        marks: dict[str, int] = {}

        def fn(rows: Iterator[tuple]) -> Iterator[tuple]:
            for i, t in rows:
                n = len(enc(t))
                free = 0
                for p in prompt_parts(t):
                    if p not in marks:
                        if len(marks) > 50_000:
                            marks.clear()
                        marks[p] = len(enc(p))
                    free += marks[p]
                yield i, n, max(0, n - free)

        return fn

    return map_rows(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col), make, f"`{id_col}` {types[id_col]}, n_tokens int, n_loss int")


def cut_items(counts: DataFrame, id_col: str, capacity: int, loss: int | None = None) -> DataFrame:
    """(id, piece_no, first_token, n_tokens, n_loss): an item above the capacity in pieces of it, the others whole; n_loss at most ``loss``."""
    loss = capacity if loss is None else loss
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    p = counts.withColumn("piece_no", F.explode(F.sequence(F.lit(1), n)))
    first = (F.col("piece_no") - 1) * capacity
    size = F.least(F.lit(capacity), F.col("n_tokens") - first)
    # The prompt opens the item, so the first piece bears the tokens without loss.
    bears = F.when(F.col("piece_no") == 1, F.greatest(size - (F.col("n_tokens") - F.col("n_loss")), F.lit(0))).otherwise(size)
    return p.select(id_col, "piece_no", first.cast("int").alias("first_token"), size.cast("int").alias("n_tokens"), F.least(bears, F.lit(loss)).cast("int").alias("n_loss"))


def pack_sizes(sizes: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Containers as (classes with their number, how many such containers), by the dot-product heuristic on size classes.

    sizes: classes x dimensions, each within the limits; counts: items of each class.
    """
    left = counts.astype(np.int64).copy()
    unit = sizes / limits
    big = np.lexsort((np.arange(len(sizes)), -unit.max(axis=1)))
    out: list[tuple[list[tuple[int, int]], int]] = []
    while True:
        alive = big[left[big] > 0]
        if not len(alive):
            return out
        room = limits.astype(np.float64).copy()
        took: dict[int, int] = {}
        k = int(alive[0])
        while True:
            took[k] = took.get(k, 0) + 1
            room -= sizes[k]
            have = left[alive].copy()
            for j, c in took.items():
                have[alive == j] -= c
            fits = alive[(have > 0) & (sizes[alive] <= room + 1e-9).all(axis=1)]
            if not len(fits):
                break
            # Room is weighted by how scarce it is against what an item of the largest kind takes.
            score = unit[fits] @ (room / limits)
            k = int(fits[int(score.argmax())])
        times = int(min(left[j] // c for j, c in took.items()))
        for j, c in took.items():
            left[j] -= c * times
        out.append((sorted(took.items()), times))


def _pack_rows(pdf, limits: np.ndarray, dims: list[str]):
    """One shard's rows with a container number each, and each container's fill."""
    size = pdf[dims].to_numpy(dtype=np.int64)
    kinds, inv, counts = np.unique(size, axis=0, return_inverse=True, return_counts=True)
    inv = inv.reshape(-1)
    order = np.lexsort((pdf["_tie"].to_numpy(), inv))
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    bins = np.zeros(len(pdf), dtype=np.int64)
    fill = np.zeros(len(pdf), dtype=np.float64)
    n = 0
    at = start.copy()
    for content, times in pack_sizes(kinds, counts, limits):
        used = sum(int(kinds[k][0]) * c for k, c in content) / limits[0]
        for _ in range(times):
            for k, c in content:
                rows = order[at[k] : at[k] + c]
                bins[rows], fill[rows] = n, used
                at[k] += c
            n += 1
    return bins, fill


def pack(pieces: DataFrame, id_col: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """(id, piece_no, first_token, n_tokens, n_loss, container): every piece in a container within all limits.

    Containers are named by shard and number; the loosely filled ones of all shards are packed again together in as many shards as they need.
    """
    loss = capacity if loss is None else loss
    limits = np.array([capacity, segments, loss], dtype=np.float64)
    cols = [id_col, "piece_no", "first_token", "n_tokens", "n_loss"]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    head = ", ".join(f"`{c}` {types[c]}" for c in cols)
    total = pieces.count()
    shards = max(1, -(-total // per_shard))

    def run(stage: str):
        def fn(pdf):
            pdf = pdf.assign(_one=1)
            pdf["_tie"] = pdf[id_col].rank(method="first") * 1e6 + pdf["piece_no"]
            bins, fill = _pack_rows(pdf, limits, ["n_tokens", "_one", "n_loss"])
            return pdf[cols].assign(container=[f"{stage}{s}-{b}" for s, b in zip(pdf["_shard"], bins)], fill=fill)

        return fn

    def packed(rows: DataFrame, n: int, stage: str, *salt):
        dealt = rows.select(*cols, F.pmod(F.xxhash64(id_col, "piece_no", *salt), F.lit(n)).cast("int").alias("_shard"))
        return dealt.repartition(n, "_shard").groupBy("_shard").applyInPandas(run(stage), f"{head}, container string, fill double")

    first = cut_lineage(packed(pieces, shards, "a"))
    loose = first.where(F.col("fill") < TOP_UP)
    again = max(1, -(-loose.count() // per_shard))
    return first.where(F.col("fill") >= TOP_UP).unionByName(packed(loose, again, "b", F.lit(1))).drop("fill")


def documents_packed(documents: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS, tokenizer: str = TOKENIZER) -> DataFrame:
    """All documents' texts packed by tokens: (doc_id, piece_no, first_token, n_tokens, n_loss, container)."""
    return pack(cut_lineage(cut_items(token_counts(documents, "doc_id", "text", tokenizer), "doc_id", capacity, loss)), "doc_id", capacity, segments, loss)


def report(packed: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """One row: containers, pieces, tokens, the share of room used, and the containers full by segments and by loss-bearing tokens before their tokens are."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("s"), F.sum("n_loss").alias("l"))
    short = F.col("t") < capacity
    return per.agg(
        F.count("*").alias("containers"),
        F.sum("s").alias("pieces"),
        F.sum("t").alias("tokens"),
        F.round(F.sum("t") / (F.count("*") * capacity), 4).alias("filled"),
        F.count_if(short & (F.col("s") == segments)).alias("full_by_segments"),
        F.count_if(short & (F.col("l") == loss)).alias("full_by_loss"),
    )

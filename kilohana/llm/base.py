"""Shared by the text operators: Arrow row mapping, table reading, language names, look-alike characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kilohana.session import table

__all__ = ["CONFUSABLE", "INVISIBLE", "LANG_NAMES", "SPACES", "URL", "URL_HINT", "canon_lang", "latest", "map_rows", "table"]

#: Addresses of sites and pages, with or without their scheme. The hint stands in every one of them and is quick to look for.
URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b(?:/\S*)?")
URL_HINT = re.compile(r"\.[a-z]{2}|://")

#: Rows given on in one Arrow batch.
OUT_ROWS = 20_000


def map_rows(df: DataFrame, make: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]], schema: str) -> DataFrame:
    """Map the partition's rows (as tuples of Python values) through ``make()``'s generator, batch by batch over Arrow.

    ``make`` is called once per task, so compiled rules and models are built once, not per row.
    """
    struct = T._parse_datatype_string(schema)
    out_schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        buf: list[tuple] = []
        for r in fn(rows()):
            buf.append(r)
            if len(buf) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*buf), out_schema)], schema=out_schema)
                buf = []
        if buf:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*buf), out_schema)], schema=out_schema)

    return df.mapInArrow(run, schema)


def latest(df: DataFrame, key: str, *cols: str, order: str = "created") -> DataFrame:
    """One row per key: the one delivered last (null ``order`` counts as earliest; ties go to the largest values)."""
    s = F.struct(F.col(order).isNotNull().alias("_k"), F.col(order).alias("_o"), *[F.col(c) for c in cols])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(s).alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in cols])


#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿‎‏؜᠎"
#: Characters that show a plain space.
SPACES = "               　"
#: Marks in use for the okina, besides U+02BB.
OKINA_MARKS = "‘’‛`'´ʼʽʹˈʿ′ꞌ＇｀"
#: Look-alike letters of other scripts and the Latin letters they show.
CONFUSABLE = {
    **dict(zip("АВЕКМНОРСТХІЈЅԜҺ", "ABEKMHOPCTXIJSWh")),
    **dict(zip("аеорсухіјѕԝһԛ", "aeopcyxijswhq")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),
    **dict(zip("οινκ", "oivk")),
    "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Full-width forms of ASCII, by their fixed distance.
WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}

#: ISO codes of the corpus languages, and the names and codes under which labels come.
LANG_NAMES = {
    "haw": ("haw", "hawaiian"),
    "en": ("en", "eng", "english"),
    "pt": ("pt", "por", "portuguese"),
    "mi": ("mi", "mri", "mao", "maori"),
    "sm": ("sm", "smo", "samoan"),
    "ja": ("ja", "jpn", "jp", "japanese"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese"),
}
_BY_NAME = {n: k for k, names in LANG_NAMES.items() for n in names}


def canon_lang(label: str | None) -> str | None:
    """The ISO code of a dirty label, or None where it names no language known here."""
    if not label:
        return None
    s = unicodedata.normalize("NFD", label.strip().lower())
    s = "".join(c for c in s if not unicodedata.combining(c))
    if s.startswith("olelo hawaii") or s.startswith("ʻolelo"):
        return "haw"
    return _BY_NAME.get(s) or _BY_NAME.get(s.replace("_", "-").split("-")[0].split(" ")[0])


def canon_lang_col(c):
    """canon_lang as a Column."""
    head = F.element_at(F.split(F.translate(F.lower(F.trim(c)), "āē_ ", "ae--"), "-"), 1)
    e = F.lit(None).cast("string")
    for k, names in LANG_NAMES.items():
        e = F.when(head.isin(*names), F.lit(k)).otherwise(e)
    return e


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)

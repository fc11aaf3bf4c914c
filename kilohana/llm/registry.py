"""Queries of the text operators, by name, and DuckDB SQL where it can say the same on whole tables."""

from __future__ import annotations

from . import langid, leaks, lookalike, mainbody, packing, reading, repeats, scans, segment, split
from .base import table


def p1_found(spark, sf):
    return segment.found(table(spark, sf, "documents"), table(spark, sf, "sentences"))


def p1_units(spark, sf):
    """Every sentence unit of every document and sentence row."""
    return segment.all_units(table(spark, sf, "documents"), table(spark, sf, "sentences"))


def p2_found(spark, sf):
    return scans.found(table(spark, sf, "documents"))


def p2_paragraphs(spark, sf):
    """Every scanned document repaired into paragraphs."""
    return scans.paragraphs(table(spark, sf, "documents"))


def p3_found(spark, sf):
    return repeats.found(table(spark, sf, "sentences"), table(spark, sf, "sources"))


def p3_cleaned(spark, sf):
    """Each source's text without the lines its group repeats."""
    return repeats.cleaned(table(spark, sf, "sentences"), table(spark, sf, "sources"))


def p4_found(spark, sf):
    return lookalike.found(table(spark, sf, "sentences"))


def p4_one_form(spark, sf):
    """Every sentence in one form, with the fold that agrees."""
    return lookalike.one_text(table(spark, sf, "sentences"))


def p4_classes(spark, sf):
    """Every row that looks like a row stored otherwise, with its class and the class's canonical text: the classes by membership, no pairs."""
    return lookalike.members(table(spark, sf, "sentences")).select("sentenceid", "class_id", "canonical")


def p5_found(spark, sf):
    return langid.found(table(spark, sf, "documents"), table(spark, sf, "sentences"))


def p5_languages(spark, sf):
    """The language and confidence of every document, typed paragraph and sentence row."""
    return langid.languages(table(spark, sf, "documents"), table(spark, sf, "sentences"))


def p6_found(spark, sf):
    return split.found(table(spark, sf, "documents"), table(spark, sf, "contents"))


def p6_pieces(spark, sf):
    """The pieces of every oversized document and page."""
    return split.all_pieces(table(spark, sf, "documents"), table(spark, sf, "contents"))


def p7_found(spark, sf):
    return mainbody.found(table(spark, sf, "contents"))


def p7_bodies(spark, sf):
    """Each page's main body as text."""
    return mainbody.bodies(table(spark, sf, "contents"))


def p8_packed(spark, sf):
    """Every piece of every document with its container."""
    return packing.documents_packed(table(spark, sf, "documents"))


def p8_report(spark, sf):
    """How full the containers are."""
    return packing.report(packing.documents_packed(table(spark, sf, "documents")))


def p9_found(spark, sf):
    return leaks.found(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_leaks(spark, sf):
    """Leaked items with the words and changed words of their longest stretch."""
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark, sf):
    return reading.found(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p10_grades(spark, sf):
    """Grade and difficulty, with the language, of every document, or the reason why it has none."""
    return reading.grades(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


_QUERIES = [p1_found, p1_units, p2_found, p2_paragraphs, p3_found, p3_cleaned, p4_found, p4_one_form, p4_classes, p5_found, p5_languages, p6_found, p6_pieces, p7_found, p7_bodies, p8_packed, p8_report, p9_found, p9_leaks, p10_found, p10_grades]

_SQL: dict[str, str] = {
    "p6_found": """
SELECT DISTINCT * FROM (
  SELECT 'documents' AS rec_table, doc_id AS rec_id FROM documents WHERE strlen(text) > 30000
  UNION ALL SELECT 'contents', sourceid FROM (
    SELECT sourceid, text, row_number() OVER (PARTITION BY sourceid ORDER BY created DESC NULLS LAST, CASE WHEN strlen(text) > 30000 THEN text END DESC NULLS LAST) AS rn FROM contents) c
  WHERE rn = 1 AND strlen(text) > 30000) t""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

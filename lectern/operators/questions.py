"""What a question says by itself: the passages that it quotes and the chapters that it numbers.

Column expressions, so any number of questions is read in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quotation marks that belong together, and the words for a chapter in several languages.
QUOTATION_MARKS = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("《", "》"), ("「", "」"))
CHAPTER_WORDS = "chapters?|chap\\.|kapiteln?|chapitres?|capítulos?|глав[аыеу]?"


def quoted_patterns() -> list[str]:
    return [f"{a}([^{a}{b}\\n]+){b}" if a != b else f"{a}([^{a}\\n]+){b}" for a, b in QUOTATION_MARKS]


def chapter_patterns() -> list[str]:
    return [rf"(?i)(?:{CHAPTER_WORDS})\s*(\d{{1,4}})", r"第\s*(\d{1,4})\s*章"]


def _every(text: Column, patterns: list[str]) -> Column:
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns)))


def quoted(question: Column) -> Column:
    """The distinct passages between quotation marks, trimmed; none for a null question."""
    return F.array_distinct(F.filter(F.transform(_every(F.coalesce(question, F.lit("")), quoted_patterns()), lambda x: F.trim(x)), lambda x: x != ""))


def chapters(question: Column) -> Column:
    """The distinct chapter numbers that a question names; none for a null question."""
    return F.array_distinct(F.transform(_every(F.coalesce(question, F.lit("")), chapter_patterns()), lambda x: x.cast("int")))

"""Text expressions that stay in the JVM: blank test, heuristic token count, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of wide East Asian characters that count as one token each.
CJK_RANGES = ((0x2E80, 0x2FFF), (0x3000, 0x303F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))

CJK_CLASS = "[" + "".join(f"\\x{{{low:04X}}}-\\x{{{high:04X}}}" for low, high in CJK_RANGES) + "]"


def is_blank(text: Column) -> Column:
    """True for null and for text without any letter or digit."""
    return ~F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def cjk_length(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, CJK_CLASS, ""))


def count_tokens(text: Column) -> Column:
    """Wide characters plus a quarter of the others, rounded up; at least 1, null for null."""
    wide = cjk_length(text)
    return F.greatest(F.lit(1), (wide + F.floor((F.length(text) - wide + 3) / 4)).cast("int"))


def contains_cjk(text: Column) -> Column:
    return text.rlike(CJK_CLASS)

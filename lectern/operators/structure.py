"""Structure inference over page and line tables: titles, tables of contents, edges, columns, outlines.

Inputs are tables of lines or entries, however they were extracted; extraction of PDF layout and
OCR are adapters outside this library.  What needs a document as a whole (alignment, stacks) is
folded per document; everything else is column expressions and windows.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell the kind of a heading, in the order in which they are tried.
KINDS = (
    ("back_matter", r"(?i)^(index|bibliography|references|notes|appendix|glossary|acknowledg|索引|参考文献|附录|注释|后记)"),
    ("front_matter", r"(?i)^(preface|foreword|introduction|contents|prologue|dedication|前言|序|目录|导论|引言)"),
    ("part", r"(?i)^(part|book|volume)\s+(\d+|[ivxlc]+)\b|^第\s*[0-9一二三四五六七八九十百]+\s*(部|卷|编)"),
    ("chapter", r"(?i)^chapter\s+(\d+|[ivxlc]+)\b|^第\s*[0-9一二三四五六七八九十百]+\s*[章回]"),
)


def heading_kind(title: Column) -> Column:
    """back_matter, front_matter, part, chapter or section."""
    kind, text = F.lit("section"), F.trim(title)
    for name, pattern in reversed(KINDS):
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
    return kind


# Letters read for digits, pairs of brackets read for a nought, and signs around a number.
MISREAD_LETTERS, MISREAD_DIGITS = "Oo〇IilS", "0001115"
MISREAD_NOUGHT = r"\(\s*>|<\s*\)|\[\s*>|>\s*\]"
AROUND_NUMBERS = "[]{}()（）<>_.,:：;；-—–"


def page_label(text: Column) -> Column:
    """The number of one to four digits printed on a page, misread signs repaired; null for any other text."""
    nought = F.regexp_replace(F.translate(text, MISREAD_LETTERS, MISREAD_DIGITS), MISREAD_NOUGHT, "0")
    bare = F.translate(F.regexp_replace(nought, r"[\s\p{Z}]+", ""), AROUND_NUMBERS, "")
    return F.when(bare.rlike(r"^[0-9]{1,4}$"), bare.cast("int"))


def edge_lines(lines: DataFrame) -> DataFrame:
    """(document, edge, signature, pages): first and last lines that recur on a fifth of the pages.

    ``lines(document, page, line, text)``; digits count as one sign, so running page numbers match."""
    signature = F.regexp_replace(F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#"), r"\s+", " ")
    place = Window.partitionBy("document", "page")
    marked = lines.where("trim(text) <> ''").withColumns({"first": F.min("line").over(place), "last": F.max("line").over(place), "signature": signature})
    edges = marked.withColumn("edge", F.when(F.col("line") == F.col("first"), "top").when(F.col("line") == F.col("last"), "bottom")).where("edge is not null")
    pages = lines.groupBy("document").agg(F.countDistinct("page").alias("n"))
    seen = edges.groupBy("document", "edge", "signature").agg(F.countDistinct("page").alias("pages")).join(pages, "document")
    return seen.where(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.2))).drop("n")


def without_edges(lines: DataFrame) -> DataFrame:
    """``lines`` less those that ``edge_lines`` finds, at the edges of pages only."""
    signature = F.regexp_replace(F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#"), r"\s+", " ")
    place = Window.partitionBy("document", "page")
    marked = lines.withColumns({"_f": F.min("line").over(place), "_l": F.max("line").over(place), "signature": signature})
    marked = marked.withColumn("edge", F.when(F.col("line") == F.col("_f"), "top").when(F.col("line") == F.col("_l"), "bottom").otherwise("-"))
    return marked.join(edge_lines(lines).select("document", "edge", "signature"), ["document", "edge", "signature"], "left_anti").select(*lines.columns)


def joined(previous: Column, current: Column) -> Column:
    """Two lines of a paragraph as one: a hyphen at the end is undone, wide scripts join without space."""
    wide = F.right(previous, F.lit(1)).rlike(r"[\x{2E80}-\x{9FFF}\x{FF00}-\x{FFEF}]") & F.left(current, F.lit(1)).rlike(r"[\x{2E80}-\x{9FFF}\x{FF00}-\x{FFEF}]")
    hyphen = previous.rlike(r"\p{L}-$") & current.rlike(r"^\p{Ll}")
    return F.when(hyphen, F.concat(F.regexp_replace(previous, "-$", ""), current)).when(wide, F.concat(previous, current)).otherwise(F.concat(previous, F.lit(" "), current))


def columns_split(lines: DataFrame, least: float = 0.12) -> DataFrame:
    """(document, page, split): where a page of two columns divides: the widest gap of line centres.

    ``lines(document, page, x0, x1, width)``; the gap must take ``least`` of the page's width."""
    centre = (F.col("x0") + F.col("x1")) / 2
    order = Window.partitionBy("document", "page").orderBy("c")
    gaps = lines.withColumn("c", centre).withColumn("next", F.lead("c").over(order)).where("next is not null")
    widest = gaps.groupBy("document", "page", "width").agg(F.max_by(F.struct("c", "next"), F.col("next") - F.col("c")).alias("g"))
    return widest.where(F.col("g.next") - F.col("g.c") >= least * F.col("width")).select("document", "page", ((F.col("g.c") + F.col("g.next")) / 2).alias("split"))


def printed_contents(lines: DataFrame) -> DataFrame:
    """(document, page, line, title, label): entries of printed tables of contents.

    A title, dots or wide space, and a page number; kept while the numbers do not fall back."""
    pattern = r"^\s*(.{2,120}?)\s*(?:[.·…]{2,}|\s{3,}|\t)\s*(\d{1,4})\s*$"
    found = lines.withColumns({"title": F.trim(F.regexp_extract("text", pattern, 1)), "label": F.nullif(F.regexp_extract("text", pattern, 2), F.lit("")).cast("int")})
    order = Window.partitionBy("document").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, -1)
    rising = found.where("label is not null").withColumn("before", F.max("label").over(order))
    return rising.where("before is null or label >= before").select("document", "page", "line", "title", "label")


def label_offsets(entries: DataFrame) -> DataFrame:
    """(document, offset, share, entries): physical less printed page, by the median of the entries.

    ``entries(document, label, page)``; kept if three entries or more and 60 % within one of it."""
    off = entries.select("document", (F.col("page") - F.col("label")).alias("off"))
    centre = off.groupBy("document").agg(F.bround(F.median("off")).cast("int").alias("offset"), F.count("*").alias("entries"))
    near = off.join(centre, "document").groupBy("document", "offset", "entries").agg(F.count_if(F.abs(F.col("off") - F.col("offset")) <= 1).alias("near"))
    return near.withColumn("share", F.col("near") / F.col("entries")).where("entries >= 3 and share >= 0.6").drop("near")


def align(candidates: DataFrame, skip: float = -0.15) -> DataFrame:
    """(document, entry, page): the best monotone choice of pages for the entries of each document.

    ``candidates(document, entry, page, score)``; pages must not fall from entry to entry, and an entry
    without a page costs ``skip``.  A document's candidates are few: twelve an entry at most are used."""
    order = Window.partitionBy("document", "entry").orderBy(F.desc("score"), "page")
    few = candidates.withColumn("_n", F.row_number().over(order)).where("_n <= 12").select("document", "entry", "page", "score")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for entry, options in group.groupby("entry"):
            after = {page: (score + skip, chosen) for page, (score, chosen) in best.items()}
            for option in options.itertuples():
                score, chosen = max((b for page, b in best.items() if page <= option.page), key=lambda b: b[0])
                value = (score + option.score, (chosen, (int(entry), int(option.page))))
                if option.page not in after or after[option.page][0] < value[0]:
                    after[option.page] = value
            best = after
        chosen, rows = max(best.values(), key=lambda b: b[0])[1], []
        while chosen:
            chosen, (entry, page) = chosen
            rows.append((group.document.iloc[0], entry, page))
        return pd.DataFrame(rows[::-1], columns=["document", "entry", "page"])

    return few.groupBy("document").applyInPandas(fold, "document string, entry int, page int")


def outline_parents(entries: DataFrame) -> DataFrame:
    """``entries(document, ordinal, level, ...)`` with ``parent``: the nearest earlier ordinal of a lower level."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        open_ones: list[tuple[int, int]] = []
        parents = []
        group = group.sort_values("ordinal")
        for level, ordinal in zip(group.level, group.ordinal):
            while open_ones and open_ones[-1][0] >= level:
                open_ones.pop()
            parents.append(open_ones[-1][1] if open_ones else None)
            open_ones.append((level, ordinal))
        return pd.DataFrame({"document": group.document, "ordinal": group.ordinal, "parent": pd.array(parents, dtype="Int32")})

    found = entries.select("document", "ordinal", "level").groupBy("document").applyInPandas(fold, "document string, ordinal int, parent int")
    return entries.join(found, ["document", "ordinal"])


def title_ratio(left: Column, right: Column) -> Column:
    """Likeness of two titles by matching blocks, 0 for titles under six characters unless equal."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x == y else 0.0 if min(len(x or ""), len(y or "")) < 6 else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    return ratio(left, right)


def page_blocks(pages: int, per_unit: int) -> list[tuple[int, int]]:
    """Page ranges of ``per_unit`` pages that cover 1 to ``pages``."""
    return [(start, min(start + per_unit - 1, pages)) for start in range(1, pages + 1, max(1, per_unit))]

"""Splitting oversized items at natural boundaries (problem 4).

A text over its limit is bisected: among the places whose weight lies in the middle half, the one
at the strongest boundary is cut, the nearest to the midpoint where several are as strong; halves
over ``limit - overlap`` are bisected again.  Every piece but the first is then given the end of
the text before it, about ``overlap`` tokens from a word boundary on, so no piece exceeds the limit.
The pieces' own parts, put together, are the text exactly.

Boundaries, strongest first: page breaks and headings, blank lines, list items and other lines,
sentence ends, clause marks, white space, any other place between two characters (never inside
a character with its combining marks or between CR and LF).

Sizes are tested in the JVM; only texts over the limit go to Python, a row at a time, with prefix
sums, so a text of n characters costs n log n.

Nulls: a null text is no case; an empty one has one token.  A null id is kept.  Repeated rows
count once; an id with several different texts has the pieces of each.  An overlap not below the
limit is cut to the limit less one.  Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import CJK_RANGES, contains_cjk, count_tokens
from lectern.llm.batches import emit, small_batches
from lectern.operators.cutting import Measured, pieces
from lectern.session import table

_PIECES = pa.schema(
    [
        ("record", pa.string()),
        ("item_id", pa.string()),
        ("piece", pa.int32()),
        ("pieces", pa.int32()),
        ("overlap_start", pa.int64()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("tokens", pa.int32()),
        ("text", pa.string()),
    ]
)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for k in range(batch.num_rows):
                record, item, text, limit, overlap = (batch.column(c)[k].as_py() for c in range(5))
                whole = Measured(text)
                cuts = pieces(whole, limit, overlap)
                for n, (begin, start, end) in enumerate(cuts):
                    yield record, item, n + 1, len(cuts), begin, start, end, whole.tokens(begin, end), text[begin:end]

    return emit(rows(), _PIECES)


def split_oversized(items: DataFrame) -> DataFrame:
    """The pieces of every item over its limit.

    ``items(record, item_id, text, max_tokens, overlap_tokens)``; items within the limit give no
    row.  Out: record, item_id, piece, pieces, overlap_start, start, end, tokens, text; ``text``
    runs from ``overlap_start`` to ``end``, the piece's own part from ``start``."""
    small_batches(items.sparkSession)
    over = items.select("record", F.col("item_id").cast("string").alias("item_id"), "text", F.col("max_tokens").cast("int").alias("m"), F.col("overlap_tokens").cast("int").alias("o"))
    over = over.where(count_tokens(F.col("text")) > F.col("m")).distinct()
    return over.mapInArrow(
        _split, "record string, item_id string, piece int, pieces int, overlap_start bigint, start bigint, end bigint, tokens int, text string"
    )


def limited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_units and chunks with the limits that hold for them."""
    limits = {(r.record, r.script): (r.max_tokens, r.overlap_tokens) for r in table(spark, sf_dir, "size_limits").collect()}

    def limited(name: str, record: str, key: str, script) -> DataFrame:
        rows = table(spark, sf_dir, name).select(F.lit(record).alias("record"), F.col(key).alias("item_id"), "text")
        for column, at in (("max_tokens", 0), ("overlap_tokens", 1)):
            value = F.lit(None).cast("int")
            for (of, kind), pair in sorted(limits.items()):
                if of == record:
                    value = F.when(script == kind, pair[at]).otherwise(value)
            rows = rows.withColumn(column, value)
        return rows

    chunk_script = F.when(contains_cjk(F.col("text")), "cjk").otherwise("latin")
    return limited("source_units", "source_unit", "unit_id", F.lit("any")).unionByName(limited("chunks", "chunk", "chunk_id", chunk_script))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(limited_items(spark, sf_dir)).where("piece = 1").select("record", "item_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(limited_items(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}

_WIDE = "length(text) - length(regexp_replace(text, '[" + "".join(f"\\x{{{low:04X}}}-\\x{{{high:04X}}}" for low, high in CJK_RANGES) + "]', '', 'g'))"

ORACLE = {
    "p4_found": f"""
WITH item AS (
  SELECT 'source_unit' AS record, unit_id AS item_id, text, {_WIDE} AS c FROM source_units WHERE text IS NOT NULL
  UNION ALL SELECT 'chunk', chunk_id, text, {_WIDE} FROM chunks WHERE text IS NOT NULL)
SELECT DISTINCT i.record, i.item_id FROM item i JOIN size_limits s ON s.record = i.record
  AND s.script = CASE WHEN i.record = 'source_unit' THEN 'any' WHEN c > 0 THEN 'cjk' ELSE 'latin' END
WHERE greatest(1, c + (length(text) - c + 3) // 4) > s.max_tokens""",
}

"""Sources as DataFrames: files of several formats, raw chapters, usage ledgers, tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.formats import PARSERS, SUFFIXES, SourceError, nested

_LOCATOR = pa.struct(
    [("format", pa.string()), ("kind", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("href", pa.string()), ("fragment", pa.string()), ("spine_id", pa.string()), ("spine_index", pa.int32())]
)
_UNITS = pa.schema([("source_path", pa.string()), ("source_hash", pa.string()), ("unit_id", pa.string()), ("ordinal", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("breadcrumb", pa.list_(pa.string())), ("text", pa.string()), ("locator", _LOCATOR), ("error", pa.string())])
_UNITS_DDL = (
    "source_path string, source_hash string, unit_id string, ordinal int, level int, title string, breadcrumb array<string>, text string, "
    "locator struct<format:string,kind:string,line_start:int,line_end:int,href:string,fragment:string,spine_id:string,spine_index:int>, error string"
)


def source_format():
    """The format of the column ``path`` by its suffix, null if unknown."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))[suffix]


#: Bytes of the largest file that is read.
MOST_BYTES = 500_000_000


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, content, format, source_hash) of files below ``path``; ``rejected_files`` has the rest."""
    files = _files(spark, path).where((F.col("length") > 0) & (F.col("length") <= most_bytes))
    return files.select("path", "length", "content", source_format().alias("format"), F.sha2("content", 256).alias("source_hash"))


def rejected_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, error) of the files below ``path`` that ``read_files`` leaves out, their content unread.

    Files without a byte have no row: a scan does not open them."""
    error = F.concat(F.lit("more bytes than "), F.lit(most_bytes))
    return _files(spark, path).where(F.col("length") > most_bytes).select("path", error.alias("error"))


def read_units(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The reading units of all files below ``path``; a file that cannot be read is a row with ``error``.

    ``breadcrumb`` has the titles from the outermost heading down to the unit's own."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content, kind, digest in zip(*(batch.column(c).to_pylist() for c in range(4))):
                rows = []
                try:
                    if kind not in PARSERS:
                        raise SourceError(f"no parser for {kind}")
                    units = PARSERS[kind](content)
                    crumbs = [c for _, c in nested([(u.level, u.title) for u in units])]
                    for number, unit in enumerate(units, 1):
                        locator = {"format": kind, "kind": f"{kind}_range"} | {k: v for k, v in unit.locator.items() if v is not None}
                        name = f"{kind}-" + hashlib.sha256(json.dumps([digest, number, locator], sort_keys=True).encode()).hexdigest()[:16]
                        rows.append((source, digest, name, number, unit.level, unit.title, crumbs[number - 1], unit.text, locator, None))
                except SourceError as error:
                    rows = [(source, digest, None, None, None, None, None, None, None, str(error))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _UNITS)], schema=_UNITS)

    read = read_files(spark, path, most_bytes).select("path", "content", "format", "source_hash").mapInArrow(parse, _UNITS_DDL)
    return read.unionByName(rejected_files(spark, path, most_bytes).withColumnRenamed("path", "source_path"), allowMissingColumns=True)


_OUTLINE = pa.schema([("source_path", pa.string()), ("ordinal", pa.int32()), ("parent", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("breadcrumb", pa.list_(pa.string())), ("unit", pa.int32())])


def read_outline(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The headings of all files below ``path``, nested: (source_path, ordinal, parent, level, title, breadcrumb,
    unit); ``parent`` is an ordinal, ``unit`` the number of the reading unit that holds the heading."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content, kind in zip(*(batch.column(c).to_pylist() for c in range(3))):
                try:
                    units = PARSERS[kind](content) if kind in PARSERS else []
                except SourceError:  # a row with its error among the units
                    units = []
                heads = [(level, title, number) for number, unit in enumerate(units, 1) for level, title in [(unit.level, unit.title), *unit.heads]]
                rows = [
                    (source, k, parent, level, title, crumb, unit)
                    for k, ((level, title, unit), (parent, crumb)) in enumerate(zip(heads, nested([h[:2] for h in heads])), 1)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUTLINE)], schema=_OUTLINE)

    files = read_files(spark, path, most_bytes).select("path", "content", "format")
    return files.mapInArrow(parse, "source_path string, ordinal int, parent int, level int, title string, breadcrumb array<string>, unit int")


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, chapter, text) of Markdown chapters; the number is the header's, else the file name's."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    given = F.regexp_extract("text", r"(?m)^>\s*Chapter:\s*(\d+)\s*$", 1)
    named = F.regexp_extract("source_path", r"/(\d+)[^/]*\.md$", 1)
    return texts.select("source_path", F.coalesce(F.nullif(given, F.lit("")), F.nullif(named, F.lit(""))).cast("int").alias("chapter"), "text")


USAGE = "run_id string, node_id string, stage string, attempt int, provider string, model string, timestamp string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, estimated boolean, cost double, status string"


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines ledger; a line that does not parse is kept in ``bad_line`` and the rest goes on."""
    return spark.read.schema(f"{USAGE}, bad_line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").json(path)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON that must fit ``schema``; anything else fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)

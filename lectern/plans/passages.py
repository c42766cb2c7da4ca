"""Line, segment and chunk queries over documents, chunks and source units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import contains_cjk, count_tokens
from lectern.operators import passages
from lectern.session import counted, cut, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic tokens and script of every document."""
    return _documents(spark, sf_dir).select("doc_id", count_tokens(F.col("text")).alias("tokens"), contains_cjk(F.col("text")).alias("cjk"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_hash"))


def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts held by more than one document, by hash, with the first document."""
    hashed = content_hashes(spark, sf_dir)
    return hashed.groupBy("content_hash").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc_id")).where("documents > 1")


def nonblank_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of non-blank lines of every document."""
    return passages.segments(_documents(spark, sf_dir), "doc_id").select("doc_id", "segment", "start_line", "end_line", F.sha2("text", 256).alias("body_hash"))


def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each non-blank run with the heading (level 2 to 6) in force at its end."""
    return passages.sections(_documents(spark, sf_dir), "doc_id")


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of consecutive runs of each document, filled up to 200 tokens."""
    return passages.greedy_groups(_documents(spark, sf_dir), "doc_id", 200)


def per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest documents of each source."""
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.row_number().over(order).alias("place")).where("place <= 3")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language-aware chunks of every document."""
    return passages.chunk(_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_path"), F.coalesce("chapter", F.lit(0)).alias("chapter"), "text"))


def chunk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check, violations): what the chunks must keep, counted over all documents."""
    chunks = cut(chunk_documents(spark, sf_dir).select("source_path", "chunk_id", "start_line", "end_line", "token_count", "content_hash", "text"))
    segments = passages.segments(_documents(spark, sf_dir), "doc_id").select(F.col("doc_id").cast("string").alias("source_path"), "start_line", "end_line", "text")
    most = F.when(contains_cjk(F.col("text")), 200).otherwise(250)
    # A text without a header is all body: each of its lines is in some chunk.
    body = segments.join(_documents(spark, sf_dir).where(~F.col("text").rlike(r"(?m)^(>|# |\s*(```|~~~))")).select(F.col("doc_id").cast("string").alias("source_path")), "source_path", "left_semi")
    wanted = body.select("source_path", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    held = chunks.select("source_path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    checks = {
        "over the maximum": chunks.where(F.col("token_count") > F.greatest(most, F.lit(250))),
        "wrong token count": chunks.where(F.col("token_count") != count_tokens(F.col("text"))),
        "wrong hash": chunks.where(F.col("content_hash") != F.sha2("text", 256)),
        "lines turned round": chunks.where("end_line < start_line"),
        "line without a chunk": wanted.join(held, ["source_path", "line"], "left_anti"),
        "blank chunk": chunks.where(F.trim("text") == ""),
    }
    return counted(checks)


def evidence_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed evidence of every document: one row per run of non-blank body lines."""
    return passages.register_evidence(_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_path"), F.coalesce("chapter", F.lit(0)).alias("chapter"), "text"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("chunk_id", "source_path", "content_hash", "text").distinct().withColumn("actual", F.sha2("text", 256))


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per path, the recorded hashes that no text has (removed) and the texts' hashes not recorded (added)."""
    chunks = _chunks(spark, sf_dir)
    old = chunks.where("content_hash is not null").select("source_path", F.col("content_hash").alias("hash")).distinct()
    new = chunks.where("actual is not null").select("source_path", F.col("actual").alias("hash")).distinct()
    removed = old.join(new, ["source_path", "hash"], "left_anti").withColumn("change", F.lit("removed"))
    return removed.unionByName(new.join(old, ["source_path", "hash"], "left_anti").withColumn("change", F.lit("added")))


def index_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and re-usable chunks (recorded hash equal to the text's) of each path."""
    return _chunks(spark, sf_dir).groupBy("source_path").agg(
        F.count("*").alias("chunks"), F.count_if(F.coalesce(F.col("content_hash") == F.col("actual"), F.lit(False))).alias("reused")
    )


def numeric_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and numbers that a text claims: a date, or a number of four signs or more, with a
    separator, per cent or a size letter."""
    found = F.regexp_extract_all("text", F.lit(r"\d{4}-\d{2}(?:-\d{2})?|\d[\d.,]*\d?[KMB%]?"), F.lit(0))
    kept = F.filter(F.array_distinct(found), lambda x: (F.length(x) >= 4) | x.rlike("[.,KMB%]"))
    return _documents(spark, sf_dir).select("doc_id", F.explode(kept).alias("candidate"))


def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines that recur in at least 3 documents and a fiftieth of their source's."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = _documents(spark, sf_dir).select("source", "doc_id", lines.alias("l")).where("source is not null and size(l) > 0")
    edges = rows.select("source", "doc_id", F.inline(F.array(F.struct(F.lit("top").alias("edge"), F.col("l")[0].alias("line")), F.struct(F.lit("bottom").alias("edge"), F.element_at("l", -1).alias("line")))))
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    counts = edges.groupBy("source", "edge", "line").agg(F.count("*").alias("documents"))
    return counts.join(sizes, "source").where(F.col("documents") >= F.greatest(F.lit(3), F.ceil(F.col("n") / 50))).drop("n")


def median_offset_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the median distance of start line and ordinal, and the share of units within one of it."""
    units = table(spark, sf_dir, "source_units").select("source_id", "unit_id", (F.col("locator.source_line_start") - F.col("ordinal")).alias("off")).distinct().where("off is not null")
    centre = units.groupBy("source_id").agg(F.median("off").alias("median"), F.count("*").alias("units"))
    near = units.join(centre, "source_id").groupBy("source_id", "median", "units").agg(F.count_if(F.abs(F.col("off") - F.bround("median")) <= 1).alias("near"))
    return near.where("units >= 3").select("source_id", "median", "units", F.round(F.col("near") / F.col("units"), 6).alias("share"))


def _unit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "source_units").select("source_path", "unit_id", F.col("locator.physical_page_start").alias("first"), F.col("locator.physical_page_end").alias("last"))
    return pages.distinct().where("first is not null and last >= first")


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by block of 20 pages of their path."""
    return _unit_pages(spark, sf_dir).groupBy("source_path", F.floor((F.col("first") - 1) / 20).alias("part")).agg(F.count("*").alias("units"), F.min("first").alias("from_page"), F.max("last").alias("to_page"))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a source's outline that no node of a level takes, between nodes of that level."""
    rows = table(spark, sf_dir, "source_nodes").where("source_id is not null and ordinal is not null and level is not null")
    places = rows.select(F.concat_ws("/", "source_id", F.col("level").cast("string")).alias("level"), "node_id", F.col("ordinal").alias("first"), F.col("ordinal").alias("last")).distinct()
    return passages.gaps(places, "level", "first", "last", "node_id")


def next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's end ordinal: the next unit's start less one."""
    units = table(spark, sf_dir, "source_units").select("source_id", "unit_id", "ordinal").distinct().where("ordinal is not null")
    order = Window.partitionBy("source_id").orderBy("ordinal", "unit_id")
    return units.withColumn("until", F.lead("ordinal").over(order) - 1)


QUERIES = {
    f.__name__: f
    for f in (
        token_counts,
        content_hashes,
        duplicate_content,
        nonblank_segments,
        section_carry_forward,
        greedy_pack,
        per_source_cap,
        chunk_documents,
        chunk_checks,
        evidence_registry,
        index_diff,
        index_reuse,
        numeric_candidates,
        repeated_edge_lines,
        median_offset_consensus,
        page_ranges,
        coverage_gaps,
        next_boundary,
    )
}

_WIDE = r"length(text) - length(regexp_replace(text, '[\x{2E80}-\x{2FFF}\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]', '', 'g'))"
_LINES = r"""
WITH doc AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\r', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM doc),
flag AS (SELECT *, NOT regexp_matches(line, '[^\s\p{Z}]') AS blank, regexp_extract(line, '^#{2,6}\s+(.+?)\s*$', 1) AS head FROM line),
isle AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS g,
  last_value(nullif(head, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM flag),
seg AS (SELECT doc_id, g, min(n) AS start_line, max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS text, arg_max(section, n) AS section FROM isle WHERE NOT blank GROUP BY 1, 2),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS segment FROM seg)
"""

ORACLE = {
    "token_counts": f"SELECT doc_id, greatest(1, c + (n - c + 3) // 4) AS tokens, c > 0 AS cjk FROM (SELECT doc_id, length(text) AS n, {_WIDE} AS c FROM documents WHERE text IS NOT NULL)",
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL",
    "duplicate_content": "SELECT sha256(text) AS content_hash, count(*) AS documents, min(doc_id) AS first_doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "nonblank_segments": _LINES + "SELECT doc_id, segment, start_line, end_line, sha256(text) AS body_hash FROM num",
    "section_carry_forward": _LINES + "SELECT doc_id, segment, start_line, end_line, coalesce(section, 'Front Matter') AS section FROM num",
    "greedy_pack": _LINES.replace("WITH doc", "WITH RECURSIVE doc")
    + f""", size AS (SELECT doc_id, segment, greatest(1, {_WIDE} + (length(text) - ({_WIDE}) + 3) // 4) AS t FROM num),
walk AS (
  SELECT doc_id, segment, t, t AS held, 1 AS pack FROM size WHERE segment = 1
  UNION ALL SELECT s.doc_id, s.segment, s.t, CASE WHEN w.held + s.t > 200 THEN s.t ELSE w.held + s.t END, CASE WHEN w.held + s.t > 200 THEN w.pack + 1 ELSE w.pack END
  FROM walk w JOIN size s ON s.doc_id = w.doc_id AND s.segment = w.segment + 1)
SELECT doc_id, pack, min(segment) AS first_segment, max(segment) AS last_segment, CAST(sum(t) AS BIGINT) AS tokens FROM walk GROUP BY 1, 2""",
    "chunk_checks": """SELECT * FROM (VALUES ('over the maximum', 0::BIGINT), ('wrong token count', 0), ('wrong hash', 0), ('lines turned round', 0), ('line without a chunk', 0), ('blank chunk', 0)) AS t("check", violations)""",
    "per_source_cap": "SELECT source, doc_id, n_chars, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents) WHERE place <= 3",
    "index_diff": """
WITH c AS (SELECT DISTINCT source_path, content_hash, sha256(text) AS actual FROM chunks)
SELECT *, 'removed' AS change FROM (SELECT source_path, content_hash AS hash FROM c WHERE content_hash IS NOT NULL EXCEPT SELECT source_path, actual FROM c)
UNION ALL SELECT *, 'added' FROM (SELECT source_path, actual AS hash FROM c WHERE actual IS NOT NULL EXCEPT SELECT source_path, content_hash FROM c)""",
    "index_reuse": "SELECT source_path, count(*) AS chunks, count(*) FILTER (content_hash = sha256(text)) AS reused FROM (SELECT DISTINCT chunk_id, source_path, content_hash, text FROM chunks) GROUP BY 1",
    "numeric_candidates": r"""
SELECT doc_id, c AS candidate FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\d{4}-\d{2}(?:-\d{2})?|\d[\d.,]*\d?[KMB%]?'))) AS c FROM documents WHERE text IS NOT NULL)
WHERE length(c) >= 4 OR regexp_matches(c, '[.,KMB%]')""",
    "repeated_edge_lines": r"""
WITH l AS (SELECT source, doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
k AS (SELECT * FROM l WHERE len(l) > 0),
e AS (SELECT source, 'top' AS edge, l[1] AS line FROM k UNION ALL SELECT source, 'bottom', l[-1] FROM k),
n AS (SELECT source, count(*) AS n FROM k GROUP BY 1)
SELECT source, edge, line, count(*) AS documents FROM e JOIN n USING (source) GROUP BY 1, 2, 3 HAVING count(*) >= greatest(3, ceil(any_value(n) / 50))""",
    "median_offset_consensus": """
WITH u AS (SELECT * FROM (SELECT DISTINCT source_id, unit_id, locator.source_line_start - ordinal AS off FROM source_units) WHERE off IS NOT NULL),
c AS (SELECT source_id, median(off) AS median, count(*) AS units FROM u GROUP BY 1)
SELECT source_id, median, units, round(count(*) FILTER (abs(off - round_even(median, 0)) <= 1) / units, 6) AS share FROM u JOIN c USING (source_id) WHERE units >= 3 GROUP BY 1, 2, 3""",
    "page_ranges": """
SELECT source_path, (first - 1) // 20 AS part, count(*) AS units, min(first) AS from_page, max(last) AS to_page
FROM (SELECT DISTINCT source_path, unit_id, locator.physical_page_start AS first, locator.physical_page_end AS last FROM source_units) WHERE first IS NOT NULL AND last >= first GROUP BY 1, 2""",
    "coverage_gaps": """
WITH u AS (SELECT DISTINCT source_id || '/' || level AS level, node_id, ordinal AS first, ordinal AS last FROM source_nodes WHERE source_id IS NOT NULL AND ordinal IS NOT NULL AND level IS NOT NULL),
g AS (SELECT *, max(last) OVER (PARTITION BY level ORDER BY first, last, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM u)
SELECT level, seen + 1 AS gap_start, first - 1 AS gap_end FROM g WHERE first > seen + 1""",
    "next_boundary": """
SELECT source_id, unit_id, ordinal, lead(ordinal) OVER (PARTITION BY source_id ORDER BY ordinal, unit_id) - 1 AS until
FROM (SELECT DISTINCT source_id, unit_id, ordinal FROM source_units) WHERE ordinal IS NOT NULL""",
}

"""Label, citation and integrity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.labels import locator_label, slug
from lectern.operators import integrity, ledger
from lectern.operators.hierarchy import reachable
from lectern.plans.outlines import _GRAPH, composition_graph
from lectern.session import table


def locator_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the place of each reading unit is shown."""
    units = table(spark, sf_dir, "source_units").select("unit_id", locator_label(F.col("locator")).alias("label"))
    return units.distinct()


def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of the outline's titles, with how many nodes share each."""
    nodes = table(spark, sf_dir, "source_nodes").select("node_id", slug(F.col("title"), "unit", fold=True).alias("slug")).distinct()
    return nodes.groupBy("slug").agg(F.count("*").alias("nodes"))


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each composition: its chapter's if its cited evidence lies in one, else a page of its own."""
    cited = table(spark, sf_dir, "retrieved_compositions").select(F.col("composition_revision_id").alias("composition"), F.explode("evidence_revision_ids").alias("evidence")).distinct()
    chapters = table(spark, sf_dir, "retrieved_evidence").select(F.col("evidence_revision_id").alias("evidence"), "chapter").distinct()
    found = cited.join(chapters, "evidence").groupBy("composition").agg(F.countDistinct("chapter").alias("chapters"), F.min("chapter").alias("chapter"))
    return found.select("composition", "chapters", F.when(F.col("chapters") == 1, F.concat(F.lit("chapters/"), F.lpad(F.col("chapter").cast("string"), 4, "0"))).otherwise(F.concat(F.lit("knowledge/"), "composition")).alias("route"))


def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of answers by number, and whether the turn retrieved so many pieces of evidence."""
    turns = ledger.latest(table(spark, sf_dir, "chat_turns").where("id is not null"), "id", "ingested_at", "answer").select(F.col("id").alias("turn_id"), "answer")
    cited = turns.select("turn_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,4})\]"), F.lit(1)))).alias("n"))
    held = table(spark, sf_dir, "retrieved_evidence").groupBy("turn_id").agg(F.countDistinct("evidence_revision_id").alias("held"))
    return cited.join(held, "turn_id", "left").select("turn_id", F.col("n").cast("int").alias("number"), (F.col("n").cast("int").between(1, F.coalesce("held", F.lit(0)))).alias("known"))


def stale_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compositions without a rendering and those that are built from them, near or far, on cycles too."""
    _, links = composition_graph(spark, sf_dir)
    # A composition depends on its members, so the links are read from member to composition.
    turned = links.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    changed = table(spark, sf_dir, "composition_revisions").where("draft_id is not null and rendering is null").select(F.col("draft_id").alias("node")).distinct()
    return integrity.stale(changed, reachable(turned))


def missing_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn numbers that a conversation lacks below its last."""
    turns = ledger.latest(table(spark, sf_dir, "chat_turns").where("id is not null"), "id", "ingested_at", "conversation_id", "turn_no")
    return integrity.missing_numbers(turns.where("conversation_id is not null"), "conversation_id", "turn_no")


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the events' numeric property by type, from their JSON."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k"), F.count(k).alias("known"))


QUERIES = {f.__name__: f for f in (locator_labels, title_slugs, page_routes, citation_numbers, stale_compositions, missing_turns, event_properties)}

_SPAN = "CASE WHEN coalesce({1}, {0}) = {0} THEN CAST({0} AS VARCHAR) ELSE CAST({0} AS VARCHAR) || '-' || CAST({1} AS VARCHAR) END"

ORACLE = {
    "locator_labels": f"""
SELECT DISTINCT unit_id, CASE WHEN locator.physical_page_start IS NOT NULL THEN 'p. ' || {_SPAN.format('locator.physical_page_start', 'locator.physical_page_end')}
  WHEN locator.href IS NOT NULL THEN locator.href || coalesce('#' || locator.fragment, '')
  WHEN locator.line_start IS NOT NULL THEN 'lines ' || {_SPAN.format('locator.line_start', 'locator.line_end')}
  WHEN locator.source_line_start IS NOT NULL THEN 'lines ' || {_SPAN.format('locator.source_line_start', 'locator.source_line_end')} END AS label FROM source_units""",
    "title_slugs": """
SELECT coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(coalesce(title, '')), '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unit-' || left(sha256(coalesce(title, '')), 12)) AS slug, count(DISTINCT node_id) AS nodes FROM source_nodes GROUP BY 1""",
    "page_routes": """
SELECT composition, count(DISTINCT chapter) AS chapters, CASE WHEN count(DISTINCT chapter) = 1 THEN 'chapters/' || lpad(CAST(min(chapter) AS VARCHAR), 4, '0') ELSE 'knowledge/' || composition END AS route
FROM (SELECT DISTINCT composition_revision_id AS composition, unnest(evidence_revision_ids) AS e FROM retrieved_compositions) c JOIN retrieved_evidence r ON r.evidence_revision_id = c.e GROUP BY 1""",
    "citation_numbers": r"""
WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, answer DESC NULLS LAST) AS rn FROM chat_turns WHERE id IS NOT NULL) WHERE rn = 1),
c AS (SELECT DISTINCT id AS turn_id, CAST(unnest(regexp_extract_all(answer, '\[(\d{1,4})\]', 1)) AS INTEGER) AS number FROM t),
h AS (SELECT turn_id, count(DISTINCT evidence_revision_id) AS held FROM retrieved_evidence GROUP BY 1)
SELECT turn_id, number, number BETWEEN 1 AND coalesce(held, 0) AS known FROM c LEFT JOIN h USING (turn_id)""",
    "stale_compositions": _GRAPH
    + """
, top AS (SELECT DISTINCT draft_id AS node FROM composition_revisions WHERE draft_id IS NOT NULL AND rendering IS NULL)
SELECT node FROM top UNION SELECT r.a FROM reach r JOIN top t ON t.node = r.b WHERE r.record = 'composition'""",
    "missing_turns": """
WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, conversation_id DESC NULLS LAST, turn_no DESC NULLS LAST) AS rn FROM chat_turns WHERE id IS NOT NULL) WHERE rn = 1 AND conversation_id IS NOT NULL AND turn_no > 0)
SELECT conversation_id, turn_no FROM (SELECT conversation_id, CAST(unnest(range(1, max(turn_no) + 1)) AS INTEGER) AS turn_no FROM t GROUP BY 1)
EXCEPT SELECT conversation_id, turn_no FROM t""",
    "event_properties": r"""
SELECT event_type, count(*) AS events, CAST(sum(k) AS BIGINT) AS k, count(k) AS known FROM (SELECT event_type, CAST(nullif(regexp_extract(props, '"k":\s*(-?\d+)', 1), '') AS BIGINT) AS k FROM events) GROUP BY 1""",
}

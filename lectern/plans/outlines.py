"""Hierarchy queries over the outline and composition tables (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.hierarchy import clean_links, full_paths, known_links, reachable, spoilt_by_cycles, squeeze
from lectern.session import cut, table


def _outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, label, breadcrumb, parent, children) of source_nodes, repeated rows once."""
    rows = table(spark, sf_dir, "source_nodes").where("node_id is not null")
    return rows.select(F.col("node_id").alias("node"), F.coalesce(squeeze(F.col("title")), F.lit("")).alias("label"), "breadcrumb", F.col("parent_id").alias("parent"), "children").distinct()


def _composition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, label, children) of composition_revisions; statements are no children."""
    rows = table(spark, sf_dir, "composition_revisions").where("draft_id is not null")
    below = F.filter("members", lambda m: F.lower(squeeze(m["member_type"])) == "composition")
    return rows.select(F.col("draft_id").alias("node"), F.col("canonical_key").alias("label"), F.transform(below, lambda m: m["draft_id"]).alias("children")).distinct()


def _graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label) and links of rows (node, label, children) with or without ``parent``.

    One end of a link is the row itself, so only the other is looked up among the nodes."""
    nodes = rows.groupBy("node").agg(F.min("label").alias("label"))
    said = F.transform(F.coalesce("children", F.array()), lambda c: F.struct(c.alias("other"), F.lit(True).alias("down")))
    if "parent" in rows.columns:
        said = F.concat(said, F.array(F.struct(F.col("parent").alias("other"), F.lit(False).alias("down"))))
    ends = rows.select("node", F.inline(said)).where("other is not null").distinct()
    ends = ends.join(nodes.select(F.col("node").alias("other")), "other", "left_semi")
    parent, child = F.when(F.col("down"), F.col("node")).otherwise(F.col("other")), F.when(F.col("down"), F.col("other")).otherwise(F.col("node"))
    return nodes, clean_links(ends.select(parent.alias("parent"), child.alias("child")))


def outline_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, label), their breadcrumbs (node, breadcrumb) and links of source_nodes.

    A link is recorded by the parent's ``children``, the child's ``parent_id`` or both."""
    rows = _outline_rows(spark, sf_dir)
    nodes, links = _graph(rows)
    return nodes, rows.select("node", "breadcrumb").distinct(), links


def composition_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label) and links of composition_revisions; statements are no nodes."""
    return _graph(_composition_rows(spark, sf_dir))


def _forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both graphs as one, so that every doubling round serves both: nodes, links and the outline's
    breadcrumbs, each node a struct (record, id).  The tables are read once."""
    outline, composition = _outline_rows(spark, sf_dir), _composition_rows(spark, sf_dir)
    missing = composition.withColumns({"breadcrumb": F.lit(None).cast("array<string>"), "parent": F.lit(None).cast("string")})

    def tagged(df: DataFrame, record: str) -> DataFrame:
        name = lambda c: F.when(c.isNotNull(), F.struct(F.lit(record).alias("record"), c.alias("id")))
        children = F.transform("children", lambda c: name(c))
        return df.select(name(F.col("node")).alias("node"), "label", "breadcrumb", name(F.col("parent")).alias("parent"), children.alias("children"))

    rows = cut(tagged(outline, "outline").unionByName(tagged(missing, "composition")))
    nodes, links = _graph(rows)
    return nodes, cut(links), rows.select("node", "breadcrumb")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, node_id, finding): nodes on or below cycles, and wrong breadcrumbs of the others.

    A breadcrumb is wrong if it is neither null nor empty and equals none of the node's paths of
    titles after normalising white space; a null title or element counts as an empty one."""
    nodes, links, crumbs = _forest(spark, sf_dir)
    spoilt = cut(spoilt_by_cycles(links))
    given = crumbs.where(F.size("breadcrumb") > 0).select(
        "node", F.transform("breadcrumb", lambda x: F.coalesce(squeeze(x), F.lit(""))).alias("given")
    )
    outline = F.col("node.record") == "outline"
    paths = full_paths(nodes.where(outline), links.where(F.col("child.record") == "outline"), spoilt.where(outline))
    wrong = paths.join(given, "node").groupBy("node", "given").agg(F.max(F.col("labels") == F.col("given")).alias("right"))
    wrong = wrong.where("not right").select("node", F.lit("wrong_breadcrumb").alias("finding")).distinct()
    return spoilt.select("node", "finding").unionByName(wrong).select("node.record", F.col("node.id").alias("node_id"), "finding")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per path: record, node_id, root_id, depth, path (ids) and path_text (titles).

    Paths lead through no node on a cycle; a node below a cycle has those from its sound roots."""
    nodes, links, _ = _forest(spark, sf_dir)
    return full_paths(nodes, links, cut(spoilt_by_cycles(links).where("finding = 'on_cycle'"))).select(
        "node.record",
        F.col("node.id").alias("node_id"),
        F.col("root.id").alias("root_id"),
        "depth",
        F.array_join("path.id", " / ").alias("path"),
        F.array_join("labels", " / ").alias("path_text"),
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, node_id, descendant_id, distance) for all nodes, on and below cycles too."""
    _, links, _ = _forest(spark, sf_dir)
    return reachable(links).select(
        "node.record", F.col("node.id").alias("node_id"), F.col("descendant.id").alias("descendant_id"), "distance"
    )


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants}

_SQUEEZE = r"trim(regexp_replace({}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))"

_GRAPH = f"""
WITH RECURSIVE onode AS (
  SELECT node_id AS node, min(coalesce({_SQUEEZE.format('title')}, '')) AS label FROM source_nodes WHERE node_id IS NOT NULL GROUP BY 1),
oraw AS (
  SELECT node_id AS parent, unnest(children) AS child FROM source_nodes
  UNION ALL SELECT parent_id, node_id FROM source_nodes),
cnode AS (SELECT draft_id AS node, min(canonical_key) AS label FROM composition_revisions WHERE draft_id IS NOT NULL GROUP BY 1),
cmem AS (SELECT draft_id AS parent, unnest(members) AS m FROM composition_revisions),
craw AS (SELECT parent, m.draft_id AS child FROM cmem WHERE lower({_SQUEEZE.format('m.member_type')}) = 'composition'),
node AS (SELECT 'outline' AS record, * FROM onode UNION ALL SELECT 'composition', * FROM cnode),
link AS (
  SELECT DISTINCT 'outline' AS record, parent, child FROM oraw WHERE parent IN (SELECT node FROM onode) AND child IN (SELECT node FROM onode)
  UNION ALL
  SELECT DISTINCT 'composition', parent, child FROM craw WHERE parent IN (SELECT node FROM cnode) AND child IN (SELECT node FROM cnode)),
reach AS (
  SELECT record, parent AS a, child AS b FROM link
  UNION SELECT r.record, r.a, l.child FROM reach r JOIN link l ON l.record = r.record AND l.parent = r.b),
cyc AS (SELECT DISTINCT record, a AS node FROM reach WHERE a = b),
spoilt AS (
  SELECT record, node, 'on_cycle' AS finding FROM cyc
  UNION ALL
  SELECT DISTINCT r.record, r.b, 'below_cycle' FROM reach r JOIN cyc c ON c.record = r.record AND c.node = r.a
  WHERE NOT EXISTS (SELECT 1 FROM cyc x WHERE x.record = r.record AND x.node = r.b))"""

_PATH = """,
path AS (
  SELECT n.record, n.node, n.node AS root, 0 AS depth, [n.node] AS ids, [n.label] AS labels FROM node n
  WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.record = n.record AND l.child = n.node)
  UNION ALL
  SELECT p.record, n.node, p.root, p.depth + 1, list_append(p.ids, n.node), list_append(p.labels, n.label)
  FROM path p JOIN link l ON l.record = p.record AND l.parent = p.node JOIN node n ON n.record = l.record AND n.node = l.child
  WHERE NOT EXISTS (SELECT 1 FROM cyc c WHERE c.record = n.record AND c.node = n.node))
"""

ORACLE = {
    "p3_found": _GRAPH
    + _PATH
    + f"""
SELECT record, node AS node_id, finding FROM spoilt
UNION ALL
SELECT 'outline', node, 'wrong_breadcrumb' FROM (
  SELECT p.node, g.given, max(CASE WHEN p.labels = g.given THEN 1 ELSE 0 END) AS hit
  FROM (SELECT * FROM path p WHERE record = 'outline' AND NOT EXISTS (SELECT 1 FROM spoilt s WHERE s.record = p.record AND s.node = p.node)) p
  JOIN (SELECT DISTINCT node_id, list_transform(breadcrumb, lambda x: coalesce({_SQUEEZE.format('x')}, '')) AS given
        FROM source_nodes WHERE len(breadcrumb) > 0) g ON g.node_id = p.node
  GROUP BY 1, 2) WHERE hit = 0 GROUP BY node""",
    "p3_paths": _GRAPH
    + _PATH
    + """
SELECT record, node AS node_id, root AS root_id, depth, array_to_string(ids, ' / ') AS path, array_to_string(labels, ' / ') AS path_text
FROM path""",
    "p3_descendants": _GRAPH
    + """,
near AS (
  SELECT record, parent AS a, child AS b, 1 AS distance FROM link WHERE parent <> child),
walk(record, a, b, distance) USING KEY (record, a, b) AS (
  SELECT * FROM near
  UNION SELECT w.record, w.a, n.b, w.distance + 1 FROM walk w JOIN near n ON n.record = w.record AND n.a = w.b
  LEFT JOIN recurring.walk x ON x.record = w.record AND x.a = w.a AND x.b = n.b WHERE x.a IS NULL AND w.a <> n.b)
SELECT record, a AS node_id, b AS descendant_id, distance FROM walk""",
}

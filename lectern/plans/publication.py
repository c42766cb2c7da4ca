"""Publication, answer plans, layers, and further joins and sequence queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import ledger, publication, search
from lectern.operators.hierarchy import levels, reachable, squeeze
from lectern.plans import knowledge
from lectern.plans.outlines import _GRAPH, _SQUEEZE, composition_graph
from lectern.session import cut, table, work_folder
from lectern.sources import formats, readers, sinks


def _compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "composition_revisions").where("draft_id is not null and composition_revision_id is not null")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(~F.isnan("score"), F.col("score"))
    rows = table(spark, sf_dir, "retrieved_evidence").where("turn_id is not null and evidence_revision_id is not null")
    return rows.select("turn_id", F.col("evidence_revision_id").alias("id"), "quote", "chapter", "source_path", score.alias("score"))


def resolved_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision of each composition's member compositions: as given, or by the member's draft."""
    rows = _compositions(spark, sf_dir).select(F.col("draft_id").alias("owner"), F.posexplode("members").alias("ordinal", "m"))
    members = rows.where(F.lower(squeeze(F.col("m.member_type"))) == "composition").select("owner", "ordinal", F.col("m.draft_id").alias("draft"), F.col("m.revision_id").alias("revision")).distinct()
    return publication.resolve(members, _compositions(spark, sf_dir).select(F.col("draft_id").alias("draft"), F.col("composition_revision_id").alias("found")))


def composition_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which compositions can be built; null for those that a cycle keeps from it."""
    nodes, links = composition_graph(spark, sf_dir)
    return levels(nodes, cut(links)).select(F.col("node").alias("composition"), "level")


def composition_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest revision of each key of a book stands, the others are superseded."""
    rows = _compositions(spark, sf_dir).select(F.col("composition_revision_id").alias("id"), "book_revision_id", "canonical_key", "created_at").distinct()
    return publication.superseded(rows, "book_revision_id", "canonical_key").select("id", "status")


def published_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compositions that stand, as a reader finds them after two publications: the first of everything,
    the second, which its pointer names, of those that stand."""
    folder, rows = work_folder(spark), composition_status(spark, sf_dir)
    none = rows.limit(0)
    sinks.publish({"compositions": rows}, folder, "first", none)
    sinks.publish({"compositions": rows.where("status = 'healthy'")}, folder, "second", none)
    return sinks.published(spark, folder, "compositions")


def draft_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement, problem): statements that cannot be published."""
    rows = table(spark, sf_dir, "retrieved_statements").where("statement_revision_id is not null")
    held = rows.groupBy(F.col("statement_revision_id").alias("statement")).agg(
        F.max("semantic_text").alias("text"), F.countDistinct("semantic_text").alias("texts"), F.max(F.size(F.coalesce("evidence_revision_ids", F.array()))).alias("named")
    )
    known = table(spark, sf_dir, "retrieved_evidence").select(F.col("evidence_revision_id").alias("e")).distinct()
    foreign = rows.select(F.col("statement_revision_id").alias("statement"), F.explode("evidence_revision_ids").alias("e")).join(known, "e", "left_anti").select("statement").distinct()
    found = held.select(
        "statement",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("named") == 0, "no support"),
                    F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text"),
                    F.when(F.col("texts") > 1, "several texts"),
                    F.when(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[.!?。！？…]['\"”’»」』)）\]]*\s*$"), "no end of a sentence"),
                )
            )
        ).alias("problem"),
    )
    return found.unionByName(foreign.withColumn("problem", F.lit("support unknown")))


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each composition rests on through all its members: statements, pieces of evidence, chapters."""
    nodes, links = composition_graph(spark, sf_dir)
    below = reachable(cut(links)).select(F.col("node").alias("composition"), F.col("descendant").alias("node")).unionByName(nodes.select(F.col("node").alias("composition"), "node"))
    members = _compositions(spark, sf_dir).select(F.col("draft_id").alias("node"), F.explode("members").alias("m"))
    said = members.where((F.lower(squeeze(F.col("m.member_type"))) == "statement") & F.col("m.revision_id").isNotNull()).select("node", F.col("m.revision_id").alias("statement")).distinct()
    support = table(spark, sf_dir, "retrieved_statements").select(F.col("statement_revision_id").alias("statement"), F.explode("evidence_revision_ids").alias("evidence")).distinct()
    places = _evidence(spark, sf_dir).select(F.col("id").alias("evidence"), "chapter").distinct()
    stated = below.join(said, "node").select("composition", "statement").distinct()
    whole = stated.join(support, "statement", "left").join(places, "evidence", "left")
    return whole.groupBy("composition").agg(F.countDistinct("statement").alias("statements"), F.countDistinct("evidence").alias("evidence"), F.countDistinct("chapter").alias("chapters"))


def answer_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's statements and evidence, sorted, under the hash of both."""
    statements = table(spark, sf_dir, "retrieved_statements").where("turn_id is not null and statement_revision_id is not null").select("turn_id", F.col("statement_revision_id").alias("id"))
    plans = publication.answer_plans(statements, _evidence(spark, sf_dir).select("turn_id", "id"))
    return plans.select("turn_id", "plan_id", F.size("statements").alias("statements"), F.size("evidence").alias("evidence"))


def stored_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plans, again): plans stored by their ids, and how many a second run of the same added."""
    folder, plans = f"{work_folder(spark)}/plans", cut(answer_plans(spark, sf_dir).select("plan_id", "statements", "evidence").distinct())
    sinks.append_once(plans, folder, "plan_id", "statements")
    again = sinks.append_once(plans, folder, "plan_id", "statements")
    return spark.read.parquet(folder).agg(F.count("*").alias("plans"), F.lit(again).cast("long").alias("again"))


def citation_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered citations of each turn."""
    return publication.citations(_evidence(spark, sf_dir))


def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading units at the path of each piece of evidence; none where the path is unknown."""
    units = table(spark, sf_dir, "source_units").groupBy("source_path").agg(F.countDistinct("unit_id").alias("units"))
    places = _evidence(spark, sf_dir).select("id", "source_path").distinct()
    return places.join(units, "source_path", "left").select("id", "source_path", F.coalesce("units", F.lit(0)).alias("units"))


def node_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that the units of an outline node take."""
    nodes = table(spark, sf_dir, "source_nodes").select("node_id", F.explode("unit_ids").alias("unit_id")).distinct()
    units = table(spark, sf_dir, "source_units").select("unit_id", F.col("locator.physical_page_start").alias("a"), F.col("locator.physical_page_end").alias("b")).distinct()
    return nodes.join(units, "unit_id").groupBy("node_id").agg(F.countDistinct("unit_id").alias("units"), F.min("a").alias("from_page"), F.max("b").alias("to_page"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(table(spark, sf_dir, "chat_turns").where("id is not null"), "id", "ingested_at", "conversation_id", "turn_no", "status", "book_revision_id", "total_tokens", "error_code")


def queued_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns in work with the size of their conversation and whether its book has compositions that stand."""
    turns = _turns(spark, sf_dir)
    sizes = turns.where("conversation_id is not null").groupBy("conversation_id").agg(F.count("*").alias("turns"), F.count_if(F.col("status") == "succeeded").alias("answered"))
    books = _compositions(spark, sf_dir).where("book_revision_id is not null").select("book_revision_id", F.lit(True).alias("known")).distinct()
    active = turns.where(F.col("status").isin(*ledger.ACTIVE))
    joined = active.join(sizes, "conversation_id").join(books, "book_revision_id", "left")
    return joined.select("id", "conversation_id", "turns", "answered", F.coalesce("known", F.lit(False)).alias("book_known"))


def requeued_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns after a crash: those in work are queued again, all others are as they were."""
    turns = _turns(spark, sf_dir)
    lost = F.col("status").isin("retrieving", "generating")
    return turns.select("id", F.when(lost, "queued").otherwise(F.col("status")).alias("status"), F.coalesce(lost, F.lit(False)).alias("requeued")).groupBy("status", "requeued").agg(F.count("*").alias("turns"))


def confidence_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_nodes").select("node_id", "kind", "confidence").distinct()
    return rows.groupBy("kind").agg(F.count("*").alias("nodes"), F.round(F.avg("confidence"), 6).alias("confidence"))


def rule_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of the tables counted by rule, with the first twelve cases of each."""
    found = cut(knowledge.health_problems(spark, sf_dir))
    order = Window.partitionBy("rule").orderBy("subject")
    few = found.withColumn("n", F.row_number().over(order)).where("n <= 12").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("subject")), ",").alias("samples"))
    return found.groupBy("rule").agg(F.count("*").alias("cases")).join(few, "rule")


def chunks_by_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each path and chapter in the order of their lines, as a hash of their ids."""
    rows = table(spark, sf_dir, "chunks").where("chunk_id is not null").select("source_path", "chapter", "start_line", "chunk_id").distinct()
    # One path's chapter is bounded by the file it was read from.
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("l"), F.col("chunk_id").alias("i")))), lambda x: x["i"])
    return rows.groupBy("source_path", "chapter").agg(F.count("*").alias("chunks"), F.sha2(F.array_join(ids, ","), 256).alias("ids_hash"))


def outline_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in the order of their source: a node is a leaf if the next is not deeper; and whether its title is
    the first of its kind there."""
    rows = table(spark, sf_dir, "source_nodes").where("source_id is not null and ordinal is not null and level is not null")
    nodes = rows.groupBy("source_id", "node_id").agg(F.min("ordinal").alias("ordinal"), F.min("level").alias("level"), F.min(F.coalesce(squeeze(F.col("title")), F.lit(""))).alias("title"))
    order = Window.partitionBy("source_id").orderBy("ordinal", "node_id")
    again = Window.partitionBy("source_id", "title").orderBy("ordinal", "node_id")
    return nodes.select("source_id", "node_id", (F.lead("level", 1, 0).over(order) <= F.col("level")).alias("leaf"), (F.row_number().over(again) == 1).alias("first_of_title"))


def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between consecutive chunks of a path: how many gaps, overlaps, and the greatest gap."""
    rows = table(spark, sf_dir, "chunks").where("start_line is not null and end_line is not null").select("source_path", "chunk_id", "start_line", "end_line").distinct()
    order = Window.partitionBy("source_path").orderBy("start_line", "end_line", "chunk_id")
    gaps = rows.withColumn("gap", F.col("start_line") - F.lag("end_line").over(order) - 1).where("gap is not null")
    return gaps.groupBy("source_path").agg(F.count_if(F.col("gap") > 0).alias("gaps"), F.count_if(F.col("gap") < 0).alias("overlaps"), F.max("gap").alias("widest"))


def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of chunks: whether they are safe (relative, without a step up) and known to some unit."""
    known = table(spark, sf_dir, "source_units").select("source_path", F.lit(True).alias("known")).distinct()
    paths = table(spark, sf_dir, "chunks").where("source_path is not null").select("source_path").distinct()
    safe = ~F.col("source_path").rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|[\x00-\x1f]")
    return paths.join(known, "source_path", "left").select("source_path", safe.alias("safe"), F.coalesce("known", F.lit(False)).alias("known"))


def source_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest title of each source: what its units name most often, then the shortest, then the first."""
    rows = table(spark, sf_dir, "source_units").select("source_id", "unit_id", squeeze(F.col("source_title")).alias("title")).distinct()
    counts = rows.where("source_id is not null and title <> ''").groupBy("source_id", "title").agg(F.count("*").alias("units"))
    best = F.min_by(F.struct("title", "units"), F.struct(-F.col("units"), F.length("title"), F.col("title")))
    return counts.groupBy("source_id").agg(best.alias("b")).select("source_id", "b.title", "b.units")


def locator_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators of units written as JSON and read again: the units whose locator came back the same."""
    rows = table(spark, sf_dir, "source_units").select("unit_id", "locator").distinct()
    back = F.from_json(F.to_json("locator"), rows.schema["locator"].dataType)
    return rows.select("unit_id", F.coalesce(F.to_json("locator") == F.to_json(back), F.col("locator").isNull()).alias("same")).groupBy("same").agg(F.count("*").alias("units"))


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into pages of HTML, with navigation and scripts around them, and read again as text."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    quoted = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>t</title><script>var x = 1;</script></head><body><nav>menu</nav><p>"), quoted, F.lit("</p><style>p {}</style></body></html>"))
    return rows.select("doc_id", F.sha2(formats.html_text_column(page), 256).alias("text_hash"))


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens by status out of a ledger of JSON lines, written from the turns and read again."""
    folder = f"{work_folder(spark)}/usage"
    turns = _turns(spark, sf_dir)
    sinks.append_usage(turns.select(F.col("id").alias("run_id"), F.lit("chat").alias("stage"), "status", "prompt_tokens", "completion_tokens", "total_tokens"), folder)
    return readers.read_usage(spark, folder).groupBy("stage", "status").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.count("bad_line").alias("bad_lines"))


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    compositions = _compositions(spark, sf_dir).select(F.col("composition_revision_id").alias("document_id"), F.col("rendering.text").alias("text"))
    navigation = table(spark, sf_dir, "source_nodes").select(F.col("node_id").alias("document_id"), F.col("title").alias("text"))
    units = table(spark, sf_dir, "source_units").select(F.col("unit_id").alias("document_id"), "text")
    return {"composition": compositions, "navigation": navigation, "unit": units}


def layer_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of documents against an index that was made before the last ones came: without ids that end on 0."""
    whole = publication.index_layers(_layers(spark, sf_dir))
    return publication.layer_health(whole, whole.where(~F.col("document_id").endswith("0")))


def layer_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nearest documents of their own layer for the compositions whose id ends on 0."""
    index = publication.index_layers(_layers(spark, sf_dir)).where("layer = 'composition'").select(F.col("document_id").alias("id"), "vector")
    asked = index.where(F.col("id").endswith("0")).withColumnRenamed("id", "query_id")
    return search.vector_search(index, asked, k=6)


QUERIES = {
    f.__name__: f
    for f in (
        resolved_members,
        composition_levels,
        composition_status,
        published_compositions,
        draft_problems,
        projection,
        answer_plans,
        stored_plans,
        citation_snapshot,
        evidence_units,
        node_pages,
        queued_turns,
        requeued_turns,
        confidence_by_kind,
        rule_samples,
        chunks_by_chapter,
        outline_leaves,
        line_gaps,
        unsafe_paths,
        source_titles,
        locator_json,
        html_texts,
        usage_ledger,
        layer_health,
        layer_topk,
    )
}

_T = """turn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, conversation_id DESC NULLS LAST, turn_no DESC NULLS LAST, status DESC NULLS LAST,
  book_revision_id DESC NULLS LAST, total_tokens DESC NULLS LAST, error_code DESC NULLS LAST) AS rn FROM chat_turns WHERE id IS NOT NULL) WHERE rn = 1)"""
_EV = "ev AS (SELECT turn_id, evidence_revision_id AS id, quote, chapter, source_path, CASE WHEN NOT isnan(score) THEN score END AS score FROM retrieved_evidence WHERE turn_id IS NOT NULL AND evidence_revision_id IS NOT NULL)"
_CR = "cr AS (SELECT * FROM composition_revisions WHERE draft_id IS NOT NULL AND composition_revision_id IS NOT NULL)"
_STATUS = f"""{_CR}, c AS (SELECT DISTINCT composition_revision_id AS id, book_revision_id, canonical_key, created_at FROM cr),
r AS (SELECT *, row_number() OVER (PARTITION BY book_revision_id, canonical_key ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM c),
status AS (SELECT id, CASE WHEN rn = 1 THEN 'healthy' ELSE 'superseded' END AS status FROM r)"""
_LAYERS = f"""{_CR}, doc AS (
  SELECT 'composition' AS layer, composition_revision_id AS document_id, max(rendering.text) AS text FROM cr WHERE trim(rendering.text, ' ') <> '' GROUP BY 2
  UNION ALL SELECT 'navigation', node_id, max(title) FROM source_nodes WHERE trim(title, ' ') <> '' GROUP BY 2
  UNION ALL SELECT 'unit', unit_id, max(text) FROM source_units WHERE trim(text, ' ') <> '' GROUP BY 2)"""
_SPACES = r"[ \t\n\x{0B}\f\r\x{1c}-\x{1f}\x{85}\p{Z}]+"

_HEALTH = knowledge.ORACLE["health_problems"]

ORACLE = {
    "resolved_members": f"""
WITH {_CR}, m AS (SELECT draft_id AS owner, unnest(members) AS m, generate_subscripts(members, 1) - 1 AS ordinal FROM cr),
k AS (SELECT DISTINCT owner, ordinal, m.draft_id AS draft, m.revision_id AS revision FROM m WHERE lower({_SQUEEZE.format('m.member_type')}) = 'composition'),
f AS (SELECT draft_id AS draft, max(composition_revision_id) AS found FROM cr GROUP BY 1)
SELECT owner, CAST(ordinal AS INTEGER) AS ordinal, k.draft, coalesce(revision, found) AS resolved, CASE WHEN revision IS NOT NULL THEN 'given' WHEN found IS NOT NULL THEN 'looked up' ELSE 'unknown' END AS how FROM k LEFT JOIN f ON f.draft = k.draft""",
    "composition_levels": _GRAPH
    + """,
never AS (SELECT node FROM cyc WHERE record = 'composition' UNION SELECT r.a FROM reach r JOIN cyc c ON c.record = r.record AND c.node = r.b WHERE r.record = 'composition'),
deep AS (
  SELECT node, 0 AS d FROM cnode WHERE node NOT IN (SELECT node FROM never)
  UNION SELECT l.parent, d + 1 FROM deep JOIN link l ON l.record = 'composition' AND l.child = deep.node WHERE l.parent NOT IN (SELECT node FROM never))
SELECT n.node AS composition, CAST(max(d) AS INTEGER) AS level FROM cnode n LEFT JOIN deep USING (node) GROUP BY 1""",
    "composition_status": f"WITH {_STATUS} SELECT * FROM status",
    "published_compositions": f"WITH {_STATUS} SELECT * FROM status WHERE status = 'healthy'",
    "draft_problems": r"""
WITH s AS (SELECT statement_revision_id AS statement, max(semantic_text) AS text, count(DISTINCT semantic_text) AS texts, max(coalesce(len(evidence_revision_ids), 0)) AS named FROM retrieved_statements WHERE statement_revision_id IS NOT NULL GROUP BY 1)
SELECT statement, 'no support' AS problem FROM s WHERE named = 0
UNION ALL SELECT statement, 'no text' FROM s WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT statement, 'several texts' FROM s WHERE texts > 1
UNION ALL SELECT statement, 'no end of a sentence' FROM s WHERE NOT regexp_matches(coalesce(text, ''), '[.!?。！？…][''"”’»」』)）\]]*\s*$')
UNION ALL SELECT DISTINCT statement_revision_id, 'support unknown' FROM (SELECT statement_revision_id, unnest(evidence_revision_ids) AS e FROM retrieved_statements) WHERE statement_revision_id IS NOT NULL AND e NOT IN (SELECT evidence_revision_id FROM retrieved_evidence WHERE evidence_revision_id IS NOT NULL)""",
    "projection": _GRAPH
    + f""",
{_CR}, {_EV},
below AS (SELECT a AS composition, b AS node FROM reach WHERE record = 'composition' UNION SELECT node, node FROM cnode),
mem AS (SELECT draft_id AS node, unnest(members) AS m FROM cr),
said AS (SELECT DISTINCT node, m.revision_id AS statement FROM mem WHERE lower({_SQUEEZE.format('m.member_type')}) = 'statement' AND m.revision_id IS NOT NULL),
support AS (SELECT DISTINCT statement_revision_id AS statement, unnest(evidence_revision_ids) AS evidence FROM retrieved_statements)
SELECT composition, count(DISTINCT s.statement) AS statements, count(DISTINCT u.evidence) AS evidence, count(DISTINCT e.chapter) AS chapters
FROM below JOIN said s USING (node) LEFT JOIN support u ON u.statement = s.statement LEFT JOIN ev e ON e.id = u.evidence GROUP BY 1""",
    "answer_plans": f"""
WITH {_EV}, p AS (SELECT turn_id, 's' AS kind, statement_revision_id AS id FROM retrieved_statements WHERE turn_id IS NOT NULL AND statement_revision_id IS NOT NULL UNION SELECT turn_id, 'e', id FROM ev),
l AS (SELECT turn_id, list_sort(coalesce(list(id) FILTER (kind = 's'), [])) AS s, list_sort(coalesce(list(id) FILTER (kind = 'e'), [])) AS e FROM p GROUP BY 1)
SELECT turn_id, 'plan-' || left(sha256(array_to_string(s, ',') || '|' || array_to_string(e, ',')), 32) AS plan_id, CAST(len(s) AS INTEGER) AS statements, CAST(len(e) AS INTEGER) AS evidence FROM l""",
    "stored_plans": f"""
WITH {_EV}, p AS (SELECT turn_id, 's' AS kind, statement_revision_id AS id FROM retrieved_statements WHERE turn_id IS NOT NULL AND statement_revision_id IS NOT NULL UNION SELECT turn_id, 'e', id FROM ev),
l AS (SELECT turn_id, list_sort(coalesce(list(id) FILTER (kind = 's'), [])) AS s, list_sort(coalesce(list(id) FILTER (kind = 'e'), [])) AS e FROM p GROUP BY 1)
SELECT count(DISTINCT (s, e)) AS plans, CAST(0 AS BIGINT) AS again FROM l""",
    "citation_snapshot": f"""
WITH {_EV}, o AS (SELECT turn_id, id, max(score) AS score, max(quote) AS quote FROM ev GROUP BY 1, 2)
SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC NULLS LAST, id) AS number, id, sha256(quote) AS quote_hash FROM o""",
    "evidence_units": f"""
WITH {_EV}, u AS (SELECT source_path, count(DISTINCT unit_id) AS units FROM source_units GROUP BY 1), p AS (SELECT DISTINCT id, source_path FROM ev)
SELECT id, p.source_path, coalesce(units, 0) AS units FROM p LEFT JOIN u ON u.source_path = p.source_path""",
    "node_pages": """
WITH n AS (SELECT DISTINCT node_id, unnest(unit_ids) AS unit_id FROM source_nodes)
SELECT node_id, count(DISTINCT unit_id) AS units, min(locator.physical_page_start) AS from_page, max(locator.physical_page_end) AS to_page FROM n JOIN source_units USING (unit_id) GROUP BY 1""",
    "queued_turns": f"""
WITH {_T}, {_CR}, s AS (SELECT conversation_id, count(*) AS turns, count(*) FILTER (status = 'succeeded') AS answered FROM turn WHERE conversation_id IS NOT NULL GROUP BY 1)
SELECT id, t.conversation_id, turns, answered, coalesce(t.book_revision_id IN (SELECT book_revision_id FROM cr WHERE book_revision_id IS NOT NULL), false) AS book_known
FROM turn t JOIN s ON s.conversation_id = t.conversation_id WHERE status IN ('queued', 'retrieving', 'generating')""",
    "requeued_turns": f"""
WITH {_T} SELECT CASE WHEN status IN ('retrieving', 'generating') THEN 'queued' ELSE status END AS status, coalesce(status IN ('retrieving', 'generating'), false) AS requeued, count(*) AS turns FROM turn GROUP BY 1, 2""",
    "confidence_by_kind": "SELECT kind, count(*) AS nodes, round(avg(confidence), 6) AS confidence FROM (SELECT DISTINCT node_id, kind, confidence FROM source_nodes) GROUP BY 1",
    "rule_samples": "WITH h AS (" + _HEALTH + """), n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY subject) AS n FROM h)
SELECT rule, count(*) AS cases, string_agg(subject, ',' ORDER BY subject) FILTER (n <= 12) AS samples FROM n GROUP BY 1""",
    "chunks_by_chapter": """
SELECT source_path, chapter, count(*) AS chunks, sha256(string_agg(chunk_id, ',' ORDER BY coalesce(start_line, 0), chunk_id)) AS ids_hash
FROM (SELECT DISTINCT source_path, chapter, start_line, chunk_id FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY 1, 2""",
    "outline_leaves": f"""
WITH n AS (SELECT source_id, node_id, min(ordinal) AS ordinal, min(level) AS level, min(coalesce({_SQUEEZE.format('title')}, '')) AS title FROM source_nodes WHERE source_id IS NOT NULL AND ordinal IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2)
SELECT source_id, node_id, lead(level, 1, 0) OVER (PARTITION BY source_id ORDER BY ordinal, node_id) <= level AS leaf, row_number() OVER (PARTITION BY source_id, title ORDER BY ordinal, node_id) = 1 AS first_of_title FROM n""",
    "line_gaps": """
WITH c AS (SELECT DISTINCT source_path, chunk_id, start_line, end_line FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
g AS (SELECT source_path, start_line - lag(end_line) OVER (PARTITION BY source_path ORDER BY start_line, end_line, chunk_id) - 1 AS gap FROM c)
SELECT source_path, count(*) FILTER (gap > 0) AS gaps, count(*) FILTER (gap < 0) AS overlaps, max(gap) AS widest FROM g WHERE gap IS NOT NULL GROUP BY 1""",
    "unsafe_paths": r"""
SELECT source_path, NOT regexp_matches(source_path, '^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|[\x00-\x1f]') AS safe, source_path IN (SELECT source_path FROM source_units WHERE source_path IS NOT NULL) AS known
FROM (SELECT DISTINCT source_path FROM chunks WHERE source_path IS NOT NULL)""",
    "source_titles": f"""
WITH t AS (SELECT DISTINCT source_id, unit_id, {_SQUEEZE.format('source_title')} AS title FROM source_units), c AS (SELECT source_id, title, count(*) AS units FROM t WHERE source_id IS NOT NULL AND title <> '' GROUP BY 1, 2)
SELECT source_id, title, units FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY units DESC, length(title), title) AS rn FROM c) WHERE rn = 1""",
    "locator_json": "SELECT true AS same, count(*) AS units FROM (SELECT DISTINCT unit_id, locator FROM source_units)",
    "html_texts": f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{_SPACES}', ' ', 'g'), '^ | $', '', 'g')) AS text_hash FROM documents WHERE text IS NOT NULL",
    "usage_ledger": f"WITH {_T} SELECT 'chat' AS stage, status, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS bad_lines FROM turn GROUP BY 2",
    "layer_health": f"""
WITH {_LAYERS} SELECT layer, count(*) AS expected, count(*) FILTER (right(document_id, 1) <> '0') AS indexed, count(*) FILTER (right(document_id, 1) = '0') AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS changed FROM doc GROUP BY 1""",
    "layer_topk": f"""
WITH {_LAYERS}, v AS (SELECT document_id AS id, [CAST(length(text) % 7 + 1 AS DOUBLE), ascii(text) % 11 + 1, ascii(right(text, 1)) % 13 + 1] AS v FROM doc WHERE layer = 'composition'),
s AS (SELECT q.id AS query_id, i.id, round(list_dot_product(q.v, i.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(i.v, i.v)), 6) AS score FROM v q CROSS JOIN v i WHERE right(q.id, 1) = '0')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 6""",
}

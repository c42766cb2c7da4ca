"""Question, coverage, support, grounding and health queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import count_tokens
from lectern.operators import context, knowledge, ledger, questions, search
from lectern.operators.hierarchy import reachable, squeeze
from lectern.plans.outlines import _GRAPH, _SQUEEZE, composition_graph
from lectern.plans.searching import _asked, _items
from lectern.session import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chat_turns").where("id is not null")
    return ledger.latest(rows, "id", "ingested_at", "question", "answer").select(F.col("id").alias("turn_id"), "question", "answer", "status")


def _hits(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    score = F.when(~F.isnan("score"), F.col("score"))
    return table(spark, sf_dir, name).where("turn_id is not null").select("turn_id", *columns, score.alias("score")).distinct()


def _analysis(turns: DataFrame) -> DataFrame:
    """``turns`` with what knowledge.coverage asks of a question, as far as the question itself tells it."""
    read = turns.withColumns({"terms": questions.quoted(F.col("question")), "chapters": questions.chapters(F.col("question"))})
    several = F.size("chapters") > 1
    return read.withColumns({"exact": F.size("terms") > 0, "overview": ~several, "several": several, "wide": F.size("chapters") == 0})


def question_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that each question quotes and the chapters it names."""
    read = _analysis(_turns(spark, sf_dir))
    return read.select("turn_id", F.array_join("terms", "|").alias("terms"), F.array_join(F.array_sort("chapters"), "|").alias("chapters"))


def coverage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each turn can be answered from its hits, by the hits' own scores."""
    decided = knowledge.coverage(
        _analysis(_turns(spark, sf_dir)),
        _hits(spark, sf_dir, "retrieved_statements", F.col("statement_revision_id").alias("id"), F.col("semantic_text").alias("text")),
        _hits(spark, sf_dir, "retrieved_compositions", "composition_revision_id", F.col("rendering_text").alias("text")),
        _hits(spark, sf_dir, "retrieved_evidence", "evidence_revision_id", "quote"),
    )
    return decided.withColumn("reasons", F.array_join("reasons", "|"))


def _asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns whose id, read as a number, is divisible by 50: the questions put to all knowledge."""
    turns = _analysis(_turns(spark, sf_dir)).where("question is not null")
    chosen = turns.where(F.conv(F.regexp_extract("turn_id", "([0-9a-f]+)$", 1), 16, 10).cast("decimal(20,0)") % 50 == 0)
    kind = F.when(F.col("exact"), "quotation").when(F.col("several"), "comparative").otherwise("factual")
    scope = F.when(F.col("wide"), "book").otherwise("reading_unit")
    composed = F.when(F.col("wide"), F.array(F.lit("overview"), F.lit("summary"))).otherwise(F.array(F.lit("chapter_summary"), F.lit("rollup")))
    return chosen.select(
        F.col("turn_id").alias("query_id"), F.col("question").alias("text"), "terms", F.get("chapters", F.lit(0)).alias("chapter"), F.array(kind).alias("kinds"), F.array(scope).alias("scopes"), composed.alias("composed")
    )


def statement_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best statements for each question: likeness, and a gain for its kind and its scope; of the
    chapter that the question names, if it names one."""
    rows = table(spark, sf_dir, "retrieved_statements").where("statement_revision_id is not null")
    items = rows.groupBy(F.col("statement_revision_id").alias("id")).agg(F.max(F.struct("semantic_text", "kind", "scope.documentary_scope", "scope.chapter")).alias("s"))
    items = items.select("id", F.col("s.semantic_text").alias("text"), "s.kind", "s.documentary_scope", "s.chapter")
    return search.set_search(items, _asking(spark, sf_dir), k=8, same="chapter", boosts=(("kind", "kinds", 0.35), ("documentary_scope", "scopes", 0.15)))


def composition_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best compositions for each question, of any chapter; a fitting kind alone may qualify one."""
    rows = table(spark, sf_dir, "retrieved_compositions").where("composition_revision_id is not null")
    items = rows.groupBy(F.col("composition_revision_id").alias("id")).agg(F.max(F.struct("rendering_text", "kind")).alias("s"))
    items = items.select("id", F.col("s.rendering_text").alias("text"), "s.kind")
    return search.set_search(items, _asking(spark, sf_dir), k=5, boosts=(("kind", "composed", 0.35),), alone=True)


def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best pieces of evidence for each question, with a gain for holding a passage it quotes."""
    rows = table(spark, sf_dir, "retrieved_evidence").where("evidence_revision_id is not null")
    items = rows.groupBy(F.col("evidence_revision_id").alias("id")).agg(F.max(F.struct("quote", "chapter")).alias("s")).select("id", F.col("s.quote").alias("text"), "s.chapter")
    return search.set_search(items, _asking(spark, sf_dir), k=8, same="chapter", alone=True, phrases=("terms", 0.8))


def support_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement-evidence pairs, and whether the evidence was retrieved in a turn of the statement."""
    edges = table(spark, sf_dir, "retrieved_statements").select("turn_id", F.col("statement_revision_id").alias("statement"), F.explode("evidence_revision_ids").alias("evidence"))
    held = table(spark, sf_dir, "retrieved_evidence").select("turn_id", F.col("evidence_revision_id").alias("evidence")).distinct().withColumn("found", F.lit(True))
    return knowledge.support_closure(edges.join(held, ["turn_id", "evidence"], "left").select("statement", "evidence", F.coalesce("found", F.lit(False)).alias("positive")))


def unsupported_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements none of whose evidence was ever retrieved with them."""
    every = table(spark, sf_dir, "retrieved_statements").select(F.col("statement_revision_id").alias("statement")).distinct()
    return every.join(support_closure(spark, sf_dir).where("positive"), "statement", "left_anti")


def evidence_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many statements and compositions cite each evidence."""
    parts = None
    for kind, name, key in (("statement", "retrieved_statements", "statement_revision_id"), ("composition", "retrieved_compositions", "composition_revision_id")):
        part = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.explode("evidence_revision_ids").alias("evidence"))
        parts = part if parts is None else parts.unionByName(part)
    # Distinct first: the hot evidence is spread by its citing ids and only counts meet.
    return parts.distinct().groupBy("evidence").agg(F.count_if(F.col("kind") == "statement").alias("statements"), F.count_if(F.col("kind") == "composition").alias("compositions"))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicting pairs among the six best statements of each turn."""
    hits = _hits(spark, sf_dir, "retrieved_statements", F.col("statement_revision_id").alias("id"), F.col("semantic_text").alias("text")).where(F.col("score") >= knowledge.LEAST["statement"])
    return knowledge.conflicts(knowledge.placed(hits, "turn_id", F.desc("score"), F.col("id")), "turn_id")


def composition_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements that each composition rests on, through its compositions, which may lie on cycles."""
    nodes, links = composition_graph(spark, sf_dir)
    below = reachable(links).select(F.col("descendant").alias("node"), F.col("node").alias("composition"))
    above = below.unionByName(nodes.select("node", F.col("node").alias("composition")))
    members = table(spark, sf_dir, "composition_revisions").select(F.col("draft_id").alias("node"), F.explode("members").alias("m"))
    statements = members.where(F.lower(squeeze(F.col("m.member_type"))) == "statement").select("node", F.col("m.draft_id").alias("statement")).distinct()
    return above.join(statements, "node").select("composition", "statement").distinct()


def grounding_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in succeeded answers that neither the turn's quotes nor its question contain."""
    turns = _turns(spark, sf_dir)

    def numbers(df: DataFrame, column: str) -> DataFrame:
        bare = F.regexp_replace(column, r"\[[^\]]*\]", " ")
        return df.select("turn_id", F.explode(F.regexp_extract_all(bare, F.lit(r"\d+"), F.lit(0))).alias("claim"))

    quotes = table(spark, sf_dir, "retrieved_evidence").select("turn_id", "quote")
    sources = numbers(quotes, "quote").unionByName(numbers(turns, "question"))
    return knowledge.ungrounded(numbers(turns.where("status = 'succeeded'"), "answer"), sources, "turn_id")


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits of each question packed into 2000 tokens, three of a chapter at most."""
    items = _items(spark, sf_dir)
    hits = search.lexical_search(items, _asked(items), k=16).join(items, "id")
    rows = hits.select("query_id", F.col("rank").cast("int").alias("rank"), F.sha2("text", 256).alias("key"), F.coalesce("chapter", F.lit(0)).alias("chapter"), "text")
    return context.pack_context(rows, 2000, 3)


def health_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, subject): what is wrong with the tables, each case once."""
    chunks = table(spark, sf_dir, "chunks")
    nodes = table(spark, sf_dir, "source_nodes")
    units = table(spark, sf_dir, "source_units")
    documents = table(spark, sf_dir, "documents")
    known_nodes, known_units = nodes.select(F.col("node_id").alias("id")).distinct(), units.select(F.col("unit_id").alias("id")).distinct()
    known_paths = units.select("source_path").distinct()
    named_units = nodes.select(F.explode("unit_ids").alias("id")).distinct()
    rules = {
        "chunk_token_count": chunks.where(~F.col("token_count").eqNullSafe(count_tokens(F.col("text")))).select("chunk_id"),
        "chunk_hash": chunks.where(F.col("content_hash") != F.sha2("text", 256)).select("chunk_id"),
        "chunk_lines": chunks.where("start_line < 1 or end_line < start_line").select("chunk_id"),
        "chunk_path_unknown": chunks.join(known_paths, "source_path", "left_anti").select("chunk_id"),
        "child_unknown": nodes.select(F.explode("children").alias("id")).join(known_nodes, "id", "left_anti").select("id"),
        "unit_unknown": named_units.join(known_units, "id", "left_anti").select("id"),
        "unit_outside_outline": known_units.join(named_units, "id", "left_anti").select("id"),
        "document_length": documents.where("n_chars <> length(text)").select(F.col("doc_id").cast("string")),
        "document_empty": documents.where("text is null or text = ''").select(F.col("doc_id").cast("string")),
    }
    found = None
    for rule, rows in rules.items():
        part = rows.select(F.lit(rule).alias("rule"), F.col(rows.columns[0]).alias("subject"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


QUERIES = {
    f.__name__: f
    for f in (
        question_readings,
        coverage_decision,
        statement_topk,
        composition_topk,
        evidence_topk,
        support_closure,
        unsupported_statements,
        evidence_use,
        conflict_pairs,
        composition_closure,
        grounding_fidelity,
        context_pack,
        health_problems,
    )
}


_TURN = "turn AS (SELECT id AS turn_id, question, answer, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, question DESC NULLS LAST, answer DESC NULLS LAST) AS rn FROM chat_turns WHERE id IS NOT NULL) WHERE rn = 1)"


def _every(patterns: list[str]) -> str:
    return "list_concat(" + ", ".join("regexp_extract_all(coalesce(question, ''), '" + p.replace("'", "''") + "', 1)" for p in patterns) + ")"


_ANALYSIS = f"""
WITH {_TURN},
said AS (SELECT turn_id, question, list_filter(list_transform({_every(questions.quoted_patterns())}, lambda x: trim(x, ' ')), lambda x: x <> '') AS ts,
  list_transform({_every(questions.chapter_patterns())}, lambda x: CAST(x AS INTEGER)) AS cs FROM turn),
analysis AS (SELECT turn_id, question, list_filter(ts, lambda x, i: list_position(ts, x) = i) AS terms, list_filter(cs, lambda x, i: list_position(cs, x) = i) AS chapters FROM said)
"""
_TOKENS = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+|[\x{{3400}}-\x{{9FFF}}]'))"
_ASKING = f"""
, ask AS (SELECT turn_id AS query_id, {_TOKENS.format('question')} AS t, terms, chapters[1] AS chapter, CASE WHEN len(terms) > 0 THEN 'quotation' WHEN len(chapters) > 1 THEN 'comparative' ELSE 'factual' END AS kind,
  CASE WHEN len(chapters) = 0 THEN 'book' ELSE 'reading_unit' END AS scope, CASE WHEN len(chapters) = 0 THEN ['overview', 'summary'] ELSE ['chapter_summary', 'rollup'] END AS composed
  FROM analysis WHERE question IS NOT NULL AND CAST('0x' || regexp_extract(turn_id, '([0-9a-f]+)$', 1) AS HUGEINT) % 50 = 0)
"""
_NEGATIONS = "['" + "', '".join(knowledge.NEGATIONS) + "']"
_NUMBERS = r"regexp_extract_all(regexp_replace({}, '\[[^\]]*\]', ' ', 'g'), '\d+')"
_TOK = r"greatest(1, c + (n - c + 3) // 4)"
_WIDE = r"length(text) - length(regexp_replace(text, '[\x{2E80}-\x{2FFF}\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]', '', 'g'))"

ORACLE = {
    "question_readings": _ANALYSIS + "SELECT turn_id, array_to_string(terms, '|') AS terms, array_to_string(list_sort(chapters), '|') AS chapters FROM analysis",
    "coverage_decision": _ANALYSIS
    + f""",
sh AS (SELECT DISTINCT turn_id, statement_revision_id AS id, semantic_text AS text, CASE WHEN NOT isnan(score) THEN score END AS score FROM retrieved_statements),
ch AS (SELECT DISTINCT turn_id, composition_revision_id, rendering_text AS text, CASE WHEN NOT isnan(score) THEN score END AS score FROM retrieved_compositions),
eh AS (SELECT DISTINCT turn_id, evidence_revision_id, quote, CASE WHEN NOT isnan(score) THEN score END AS score FROM retrieved_evidence),
pl AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, id) AS place, {_TOKENS.format('text')} AS t FROM sh WHERE score >= 0.2),
wd AS (SELECT turn_id, place, list_filter(t, lambda x: NOT list_contains({_NEGATIONS}, x)) AS w, list_has_any(t, {_NEGATIONS}) AS neg FROM pl WHERE place <= {knowledge.SELECTED}),
cf AS (SELECT DISTINCT a.turn_id FROM wd a JOIN wd b ON a.turn_id = b.turn_id AND a.place < b.place AND a.neg <> b.neg AND len(list_intersect(a.w, b.w)) >= 3),
sa AS (SELECT turn_id, least(count(*) FILTER (score >= 0.2), {knowledge.SELECTED}) AS ns, max(score) AS sm FROM sh GROUP BY 1),
ca AS (SELECT turn_id, count(*) FILTER (score >= 0.35 AND trim(text) <> '') AS nc, max(score) AS cm FROM ch GROUP BY 1),
ea AS (SELECT turn_id, count(*) FILTER (CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: NOT contains(lower(quote), lower(t)))) = 0 ELSE score >= 0.15 END) AS ne, max(score) AS em
  FROM eh JOIN analysis USING (turn_id) GROUP BY 1),
al AS (SELECT a.turn_id, len(terms) > 0 AS exact, len(chapters) > 1 AS several, len(chapters) = 0 AS wide, a.turn_id IN (SELECT turn_id FROM cf) AS conflict, coalesce(nc, 0) AS nc,
  coalesce(ns, 0) AS ns, coalesce(ne, 0) AS ne, round(coalesce(sm, 0), 6) AS statement_max, round(coalesce(cm, 0), 6) AS composition_max, round(coalesce(em, 0), 6) AS evidence_max
  FROM analysis a LEFT JOIN sa USING (turn_id) LEFT JOIN ca USING (turn_id) LEFT JOIN ea USING (turn_id)),
be AS (SELECT *, NOT exact AND NOT several AND nc > 0 AS composed FROM al),
de AS (SELECT *, composed AND NOT conflict AS canonical_complete, several AND ns < 2 AS few, wide AND ns < 2 AND NOT composed AS thin,
  ns > 0 AND NOT (several AND ns < 2) AND NOT (wide AND ns < 2 AND NOT composed) AND NOT conflict AS knowledge_complete, ne > 0 AND NOT (several AND ne < 2) AS raw_complete FROM be)
SELECT turn_id, CASE WHEN canonical_complete THEN 'canonical_passthrough' WHEN knowledge_complete AND NOT exact THEN 'knowledge_synthesis' ELSE 'raw_synthesis' END AS answer_mode,
  canonical_complete OR knowledge_complete OR raw_complete AS sufficient, canonical_complete, knowledge_complete, raw_complete, conflict,
  concat_ws('|', CASE WHEN few THEN 'relation_requires_multiple_knowledge_nodes' END, CASE WHEN thin THEN 'cross_scope_knowledge_is_incomplete' END, CASE WHEN conflict THEN 'knowledge_conflict_detected' END,
    CASE WHEN canonical_complete THEN 'complete_canonical_composition' WHEN knowledge_complete AND NOT exact THEN 'positive_knowledge_closure' ELSE 'raw_evidence_required' END,
    CASE WHEN NOT (canonical_complete OR knowledge_complete OR raw_complete) THEN 'insufficient_pinned_evidence' END) AS reasons,
  statement_max, composition_max, evidence_max FROM de""",
    "statement_topk": _ANALYSIS
    + _ASKING
    + f""", item AS (
  SELECT statement_revision_id AS id, max(row(semantic_text, kind, scope.documentary_scope, scope.chapter)) AS s FROM retrieved_statements WHERE statement_revision_id IS NOT NULL GROUP BY 1),
named AS (SELECT id, {_TOKENS.format('s[1]')} AS t, s[2] AS kind, s[3] AS scope, s[4] AS chapter FROM item),
base AS (SELECT q.query_id, i.id, q.kind = i.kind AS k, q.scope = i.scope AS c, round(len(list_intersect(q.t, i.t)) / sqrt(len(q.t) * len(i.t)), 6) AS b
  FROM ask q JOIN named i ON (q.chapter IS NULL OR q.chapter = i.chapter) AND len(list_intersect(q.t, i.t)) > 0)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(b + CASE WHEN k THEN 0.35 ELSE 0 END + CASE WHEN c THEN 0.15 ELSE 0 END, 6) AS score FROM base)) WHERE rank <= 8""",
    "composition_topk": _ANALYSIS
    + _ASKING
    + f""", item AS (SELECT composition_revision_id AS id, max(row(rendering_text, kind)) AS s FROM retrieved_compositions WHERE composition_revision_id IS NOT NULL GROUP BY 1),
named AS (SELECT id, {_TOKENS.format('s[1]')} AS t, s[2] AS kind FROM item)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.query_id, i.id, round(round(CASE WHEN len(q.t) * len(i.t) > 0 THEN len(list_intersect(q.t, i.t)) / sqrt(len(q.t) * len(i.t)) ELSE 0 END, 6) + CASE WHEN list_contains(q.composed, i.kind) THEN 0.35 ELSE 0 END, 6) AS score
  FROM ask q CROSS JOIN named i WHERE len(q.t) > 0) WHERE score > 0) WHERE rank <= 5""",
    "evidence_topk": _ANALYSIS
    + _ASKING
    + f""", item AS (SELECT evidence_revision_id AS id, max(row(quote, chapter)) AS s FROM retrieved_evidence WHERE evidence_revision_id IS NOT NULL GROUP BY 1),
named AS (SELECT id, s[1] AS quote, {_TOKENS.format('s[1]')} AS t, s[2] AS chapter FROM item)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.query_id, i.id, round(round(CASE WHEN len(q.t) * len(i.t) > 0 THEN len(list_intersect(q.t, i.t)) / sqrt(len(q.t) * len(i.t)) ELSE 0 END, 6)
    + CASE WHEN len(list_filter(q.terms, lambda x: contains(lower(i.quote), lower(x)))) > 0 THEN 0.8 ELSE 0 END, 6) AS score
  FROM ask q JOIN named i ON q.chapter IS NULL OR q.chapter = i.chapter WHERE len(q.t) > 0) WHERE score > 0) WHERE rank <= 8""",
    "support_closure": """
SELECT statement, evidence, bool_or(e.turn_id IS NOT NULL) AS positive FROM (SELECT turn_id, statement_revision_id AS statement, unnest(evidence_revision_ids) AS evidence FROM retrieved_statements) s
LEFT JOIN (SELECT DISTINCT turn_id, evidence_revision_id FROM retrieved_evidence) e ON e.turn_id = s.turn_id AND e.evidence_revision_id = s.evidence GROUP BY 1, 2""",
    "unsupported_statements": """
SELECT DISTINCT statement_revision_id AS statement FROM retrieved_statements s WHERE statement_revision_id NOT IN (
  SELECT x.statement_revision_id FROM (SELECT turn_id, statement_revision_id, unnest(evidence_revision_ids) AS e FROM retrieved_statements) x
  JOIN retrieved_evidence r ON r.turn_id = x.turn_id AND r.evidence_revision_id = x.e)""",
    "evidence_use": """
SELECT evidence, count(DISTINCT id) FILTER (kind = 's') AS statements, count(DISTINCT id) FILTER (kind = 'c') AS compositions FROM (
  SELECT 's' AS kind, statement_revision_id AS id, unnest(evidence_revision_ids) AS evidence FROM retrieved_statements
  UNION ALL SELECT 'c', composition_revision_id, unnest(evidence_revision_ids) FROM retrieved_compositions) GROUP BY 1""",
    "conflict_pairs": f"""
WITH h AS (SELECT DISTINCT turn_id, statement_revision_id AS id, semantic_text AS text, score FROM retrieved_statements WHERE NOT isnan(score) AND score >= 0.2),
p AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, id) AS place, {_TOKENS.format('text')} AS t FROM h),
w AS (SELECT turn_id, id, place, list_filter(t, lambda x: NOT list_contains({_NEGATIONS}, x)) AS w, list_has_any(t, {_NEGATIONS}) AS neg FROM p WHERE place <= {knowledge.SELECTED})
SELECT a.turn_id, a.id AS a, b.id AS b FROM w a JOIN w b ON a.turn_id = b.turn_id AND a.place < b.place AND a.neg <> b.neg AND len(list_intersect(a.w, b.w)) >= 3""",
    "composition_closure": _GRAPH
    + f"""
SELECT DISTINCT p.composition, m.m.draft_id AS statement FROM (SELECT a AS composition, b AS node FROM reach WHERE record = 'composition' UNION SELECT node, node FROM cnode) p
JOIN cmem m ON m.parent = p.node WHERE lower({_SQUEEZE.format('m.m.member_type')}) = 'statement'""",
    "grounding_fidelity": f"""
WITH {_TURN},
c AS (SELECT DISTINCT turn_id, unnest({_NUMBERS.format('answer')}) AS claim FROM turn WHERE status = 'succeeded'),
s AS (SELECT turn_id, unnest({_NUMBERS.format('quote')}) AS claim FROM retrieved_evidence UNION SELECT turn_id, unnest({_NUMBERS.format('question')}) FROM turn)
SELECT turn_id, claim FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.turn_id = c.turn_id AND s.claim = c.claim)""",
    "health_problems": f"""
WITH ck AS (SELECT *, length(text) AS n, {_WIDE} AS c FROM chunks), named AS (SELECT DISTINCT unnest(unit_ids) AS id FROM source_nodes)
SELECT 'chunk_token_count' AS rule, chunk_id AS subject FROM ck WHERE token_count IS DISTINCT FROM {_TOK}
UNION SELECT 'chunk_hash', chunk_id FROM chunks WHERE content_hash <> sha256(text)
UNION SELECT 'chunk_lines', chunk_id FROM chunks WHERE start_line < 1 OR end_line < start_line
UNION SELECT 'chunk_path_unknown', chunk_id FROM chunks WHERE source_path IS NULL OR source_path NOT IN (SELECT source_path FROM source_units WHERE source_path IS NOT NULL)
UNION SELECT 'child_unknown', id FROM (SELECT unnest(children) AS id FROM source_nodes) WHERE id NOT IN (SELECT node_id FROM source_nodes)
UNION SELECT 'unit_unknown', id FROM named WHERE id NOT IN (SELECT unit_id FROM source_units)
UNION SELECT 'unit_outside_outline', unit_id FROM source_units WHERE unit_id NOT IN (SELECT id FROM named)
UNION SELECT 'document_length', CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars <> length(text)
UNION SELECT 'document_empty', CAST(doc_id AS VARCHAR) FROM documents WHERE text IS NULL OR text = ''""",
}

"""Search queries: documents and embeddings whose id is divisible by 50 are the questions, asked of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.terms import set_cosine, title_similarity, token_set
from lectern.operators import search
from lectern.plans.outlines import _GRAPH, outline_graph
from lectern.session import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", "chapter")


def _asked(items: DataFrame) -> DataFrame:
    return items.where("id % 50 = 0").withColumnRenamed("id", "query_id")


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequency(_items(spark, sf_dir))


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return search.lexical_search(items, _asked(items), tie="chapter")


def lexical_topk_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``lexical_topk``, only among documents of the question's chapter, if it has one."""
    items = _items(spark, sf_dir)
    return search.lexical_search(items, _asked(items), same="chapter", tie="chapter")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return items, items.where("id % 50 = 0").withColumnRenamed("id", "query_id")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(*_vectors(spark, sf_dir), k=10)


def vector_topk_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``vector_topk``, only among vectors of the question's label."""
    items, asked = _vectors(spark, sf_dir)
    return search.vector_search(items, asked.withColumn("labels", F.array("label")), k=10, tag="label", tags="labels")


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 nearest vectors, the most a search returns, among those of a set of labels, the set being
    the question's own: its label, the next and the one after."""
    items, asked = _vectors(spark, sf_dir)
    return search.vector_search(items, asked.withColumn("labels", F.array("label", F.col("label") + 1, F.col("label") + 2)), k=12, tag="label", tags="labels")


def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``vector_topk`` through an index of cells, with a recall of 0.9 or more."""
    items, asked = _vectors(spark, sf_dir)
    index = search.CellIndex(items)
    return index.search(index.assign(items), asked)


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(queries, enough): whether ``vector_topk_indexed`` finds 0.9 of what ``vector_topk`` finds."""
    exact, near = vector_topk(spark, sf_dir), vector_topk_indexed(spark, sf_dir).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def set_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return search.set_search(items, _asked(items))


def _lists(spark: SparkSession, sf_dir: str, depth: int) -> tuple[DataFrame, DataFrame]:
    items = _items(spark, sf_dir)
    keys = items.select("id", F.sha2("text", 256).alias("key"))
    lexical = search.lexical_search(items, _asked(items), k=depth, tie="chapter")
    sets = search.set_search(items, _asked(items), k=depth)
    return lexical.join(keys, "id"), sets.join(keys, "id")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and set-cosine lists fused by content; equal texts are one hit."""
    lexical, sets = _lists(spark, sf_dir, 16)
    return search.reciprocal_rank_fusion({"lexical": (lexical, 1.0), "sets": (sets, 1.0)})


def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, sets = _lists(spark, sf_dir, 16)
    return search.reciprocal_rank_fusion({"lexical": (lexical, 2.0), "sets": (sets, 0.5)}, rrf_k=20)


def hybrid_hits(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """The lexical and the vector list of each question, twice as deep as asked for, fused by document."""
    items = _items(spark, sf_dir)
    asked = _asked(items)
    vectors, questions = _vectors(spark, sf_dir)
    held = items.select("id")
    lexical = search.lexical_search(items, asked, k=2 * k, tie="chapter")
    near = search.vector_search(vectors.join(held, "id", "left_semi"), questions.join(asked.select("query_id"), "query_id", "left_semi"), k=2 * k)
    lists = {"lexical": (lexical.withColumnRenamed("id", "key"), 1.0), "vector": (near.withColumnRenamed("id", "key"), 1.0)}
    return search.reciprocal_rank_fusion(lists, k=k).withColumnRenamed("key", "id")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector search of the documents fused by rank."""
    return hybrid_hits(spark, sf_dir)


def _reranked(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    items = _items(spark, sf_dir)
    texts = _asked(items).select("query_id", F.col("text").alias("query_text"))
    # Hits are k rows a question and few bytes before they get their texts; a fixed number of partitions
    # keeps the work on long texts from being put together in one task.
    held = hits.join(items.select("id", "text"), "id").join(texts, "query_id")
    return search.rerank(held.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "query_id", "id"))


def local_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical hits, re-ranked by phrase and word overlap."""
    items = _items(spark, sf_dir)
    hits = _reranked(spark, sf_dir, search.lexical_search(items, _asked(items), tie="chapter"))
    return hits.select("query_id", "id", "phrase", "overlap", "new_score", "new_rank")


def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lexical and vector lists fused by rank, then re-ranked by phrase and word overlap."""
    hits = _reranked(spark, sf_dir, hybrid_hits(spark, sf_dir))
    return hits.select("query_id", "id", "lexical_rank", "vector_rank", "phrase", "overlap", "new_score", "new_rank")


def statement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each retrieved statement's set cosine with the question of its turn."""
    turns = table(spark, sf_dir, "chat_turns").groupBy(F.col("id").alias("turn_id")).agg(F.max_by("question", F.struct("ingested_at", "question")).alias("question"))
    hits = table(spark, sf_dir, "retrieved_statements").select("turn_id", "statement_revision_id", "semantic_text").distinct()
    score = F.round(set_cosine(token_set(F.col("question")), token_set(F.col("semantic_text"))), 6)
    return hits.join(turns, "turn_id").select("turn_id", "statement_revision_id", score.alias("score"))


def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeness of each outline node's title to its parent's."""
    nodes, _, links = outline_graph(spark, sf_dir)
    up = nodes.select(F.col("node").alias("parent"), F.col("label").alias("above"))
    down = nodes.select(F.col("node").alias("child"), F.col("label").alias("below"))
    return links.join(up, "parent").join(down, "child").select("parent", "child", F.round(title_similarity(F.col("above"), F.col("below")), 6).alias("likeness"))


QUERIES = {
    f.__name__: f
    for f in (
        term_document_frequency,
        lexical_topk,
        lexical_topk_chapter,
        vector_topk,
        vector_topk_label,
        vector_topk_filtered,
        vector_topk_indexed,
        vector_index_recall,
        set_cosine_topk,
        rrf_fusion,
        weighted_rrf,
        local_rerank,
        hybrid_topk,
        hybrid_rerank,
        statement_scores,
        title_pairs,
    )
}

_TERMS = r"""list_concat(regexp_extract_all(lower(text), '[\p{L}\p{N}_''-]+'),
  flatten(list_transform(regexp_extract_all(lower(text), '[\x{3400}-\x{9FFF}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: r[i:i+1]) END)))"""
_TOKENS = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+|[\x{{3400}}-\x{{9FFF}}]'))"

_LEXICAL = """
WITH item AS (SELECT doc_id AS id, text, chapter FROM documents WHERE text IS NOT NULL),
word AS (SELECT id, unnest(@TERMS) AS term FROM item),
post AS (SELECT id, term, count(*) AS tf FROM word GROUP BY 1, 2),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
num AS (SELECT count(*) AS n FROM item),
score AS (
  SELECT q.id AS query_id, p.id, round(sum(q.tf * (1 + ln(p.tf)) * (ln((n + 1) / (df + 1)) + 1)), 6) AS score
  FROM post q JOIN post p USING (term) JOIN freq USING (term) CROSS JOIN num WHERE q.id % 50 = 0 @MORE GROUP BY 1, 2),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, (SELECT chapter FROM item i WHERE i.id = score.id) NULLS LAST, id) AS rank FROM score WHERE score > 0))
""".replace("@TERMS", _TERMS)
_SETS = f"""
, tok AS (SELECT id, {_TOKENS.format('text')} AS t FROM item),
sets AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.id AS query_id, i.id, round(len(list_intersect(q.t, i.t)) / sqrt(len(q.t) * len(i.t)), 6) AS score
  FROM tok q JOIN tok i ON q.id % 50 = 0 AND len(list_intersect(q.t, i.t)) > 0))
"""
_RRF = """
, key AS (SELECT id, sha256(text) AS key FROM item),
entry AS (
  SELECT query_id, key, rank, 'lexical' AS l, {0} AS w FROM lexical JOIN key USING (id) WHERE rank <= 16
  UNION ALL SELECT query_id, key, rank, 'sets', {1} FROM sets JOIN key USING (id) WHERE rank <= 16),
fused AS (SELECT query_id, key, round(sum(w / ({2} + rank)), 6) AS score, min(CASE WHEN l = 'lexical' THEN rank END) AS lexical_rank, min(CASE WHEN l = 'sets' THEN rank END) AS sets_rank FROM entry GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical_rank NULLS LAST, sets_rank NULLS LAST, key) AS rank FROM fused) WHERE rank <= 8"""
_COSINE = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, i.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))
    / coalesce(nullif(sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 0), 1)
    / coalesce(nullif(sqrt(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))), 0), 1), 6) AS score
  FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 {})) WHERE rank <= {}"""
_HYBRID = """
, near AS (SELECT query_id, id, rank FROM (""" + _COSINE.format("AND q.vec_id IN (SELECT id FROM item) AND i.vec_id IN (SELECT id FROM item)", 16) + """)),
pair AS (
  SELECT query_id, id, rank, 'lexical' AS l FROM lexical WHERE rank <= 16
  UNION ALL SELECT query_id, id, rank, 'vector' FROM near),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical_rank NULLS LAST, vector_rank NULLS LAST, id) AS rank FROM (
  SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score, min(CASE WHEN l = 'lexical' THEN rank END) AS lexical_rank, min(CASE WHEN l = 'vector' THEN rank END) AS vector_rank FROM pair GROUP BY 1, 2)) WHERE rank <= 8)
"""

ORACLE = {
    "term_document_frequency": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "lexical_topk": _LEXICAL.replace("@MORE", "") + "SELECT * FROM lexical WHERE rank <= 8",
    "lexical_topk_chapter": _LEXICAL.replace("@MORE", "AND coalesce((SELECT chapter FROM item i WHERE i.id = q.id) IS NOT DISTINCT FROM (SELECT chapter FROM item i WHERE i.id = p.id), true) OR (q.id % 50 = 0 AND (SELECT chapter FROM item i WHERE i.id = q.id) IS NULL)") + "SELECT * FROM lexical WHERE rank <= 8",
    "vector_topk": _COSINE.format("", 10),
    "vector_topk_label": _COSINE.format("AND q.label = i.label", 10),
    "vector_topk_filtered": _COSINE.format("AND i.label BETWEEN q.label AND q.label + 2", 12),
    "vector_index_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "hybrid_topk": _LEXICAL.replace("@MORE", "") + _HYBRID + "SELECT query_id, id, score, lexical_rank, vector_rank, rank FROM hybrid",
    "hybrid_rerank": _LEXICAL.replace("@MORE", "")
    + _HYBRID
    + f"""
, t AS (SELECT id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS flat, list_distinct({_TERMS}) AS terms FROM item),
s AS (SELECT l.*, CASE WHEN trim(q.flat) <> '' AND contains(i.flat, trim(q.flat)) THEN 1 ELSE 0 END AS phrase,
  round(len(list_intersect(q.terms, i.terms)) / greatest(len(q.terms), 1), 6) AS overlap
  FROM hybrid l JOIN t q ON q.id = l.query_id JOIN t i ON i.id = l.id)
SELECT query_id, id, lexical_rank, vector_rank, phrase, overlap, round(score + overlap + phrase, 6) AS new_score,
  row_number() OVER (PARTITION BY query_id ORDER BY phrase DESC, overlap DESC, score DESC, rank, id) AS new_rank FROM s""",
    "set_cosine_topk": _LEXICAL.replace("@MORE", "") + _SETS + "SELECT * FROM sets WHERE rank <= 8",
    "rrf_fusion": _LEXICAL.replace("@MORE", "") + _SETS + _RRF.format("1.0", "1.0", 60),
    "weighted_rrf": _LEXICAL.replace("@MORE", "") + _SETS + _RRF.format("2.0", "0.5", 20),
    "local_rerank": _LEXICAL.replace("@MORE", "")
    + f"""
, t AS (SELECT id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS flat, list_distinct({_TERMS}) AS terms FROM item),
s AS (SELECT l.*, CASE WHEN trim(q.flat) <> '' AND contains(i.flat, trim(q.flat)) THEN 1 ELSE 0 END AS phrase,
  round(len(list_intersect(q.terms, i.terms)) / greatest(len(q.terms), 1), 6) AS overlap
  FROM lexical l JOIN t q ON q.id = l.query_id JOIN t i ON i.id = l.id WHERE rank <= 8)
SELECT query_id, id, phrase, overlap, round(score + overlap + phrase, 6) AS new_score,
  row_number() OVER (PARTITION BY query_id ORDER BY phrase DESC, overlap DESC, score DESC, rank, id) AS new_rank FROM s""",
    "statement_scores": f"""
WITH t AS (SELECT id AS turn_id, question FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, question DESC) AS rn FROM chat_turns) WHERE rn = 1),
h AS (SELECT DISTINCT turn_id, statement_revision_id, semantic_text FROM retrieved_statements),
s AS (SELECT turn_id, statement_revision_id, {_TOKENS.format('question')} AS q, {_TOKENS.format('semantic_text')} AS c FROM h JOIN t USING (turn_id))
SELECT turn_id, statement_revision_id, CASE WHEN len(q) * len(c) > 0 THEN round(len(list_intersect(q, c)) / sqrt(len(q) * len(c)), 6) ELSE 0.0 END AS score FROM s""",
    "title_pairs": _GRAPH
    + """
, pair AS (SELECT l.parent, l.child, a.label AS x, b.label AS y FROM link l JOIN onode a ON a.node = l.parent JOIN onode b ON b.node = l.child WHERE l.record = 'outline'),
gram AS (SELECT *, CASE WHEN length(x) < 2 THEN [x] ELSE list_distinct(list_transform(range(1, length(x)), lambda i: x[i:i+1])) END AS gx,
  CASE WHEN length(y) < 2 THEN [y] ELSE list_distinct(list_transform(range(1, length(y)), lambda i: y[i:i+1])) END AS gy FROM pair)
SELECT parent, child, round(CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0
  WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) / greatest(length(x), length(y)) * 0.35 + 0.65
  ELSE len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy))) END, 6) AS likeness FROM gram""",
}

"""Structure, label and fidelity queries over the lines of documents, titles, quotes and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.labels import slug
from lectern.operators import integrity, ledger, passages, questions, structure
from lectern.operators.hierarchy import squeeze
from lectern.plans.knowledge import _every
from lectern.plans.outlines import _SQUEEZE
from lectern.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, page, line, text) of all documents; pages end at form feeds."""
    pages = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\f")).alias("page", "page_text"))
    return pages.select("document", "page", F.posexplode(F.split("page_text", r"\r\n|\r|\n")).alias("line", "text"))


def heading_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each title of the outline."""
    titles = table(spark, sf_dir, "source_nodes").select(squeeze(F.col("title")).alias("title")).where("title <> ''").distinct()
    return titles.select("title", structure.heading_kind(F.col("title")).alias("kind"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines of documents that are page numbers, repaired."""
    rows = _lines(spark, sf_dir).where("length(text) between 1 and 8")
    return rows.select("document", "page", "line", structure.page_label(F.col("text")).alias("label")).where("label is not null")


def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read from tables of contents that are printed from the outlines: title, dots and number."""
    nodes = table(spark, sf_dir, "source_nodes").where("source_id is not null and ordinal is not null").groupBy("source_id", "node_id", "ordinal").agg(F.min(squeeze(F.col("title"))).alias("title"))
    order = Window.partitionBy("source_id").orderBy("ordinal", "node_id")
    text = F.concat(F.lit(" "), F.coalesce("title", F.lit("")), F.lit(" ....... "), F.col("ordinal").cast("string"))
    return structure.printed_contents(nodes.select(F.col("source_id").alias("document"), F.lit(0).alias("page"), F.row_number().over(order).alias("line"), text.alias("text")))


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines that recur over the pages of a source, a page being a unit under the source's title."""
    units = table(spark, sf_dir, "source_units").where("source_id is not null and ordinal is not null").select("source_id", "ordinal", "source_title", "title", "text").distinct()
    body = F.split(F.concat_ws("\n", "source_title", "title", "text", F.concat(F.lit("- "), F.col("ordinal").cast("string"), F.lit(" -"))), r"\r\n|\r|\n|\f")
    return structure.edge_lines(units.select(F.col("source_id").alias("document"), F.col("ordinal").alias("page"), F.posexplode(body).alias("line", "text")))


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document that does not end a sentence with the next one, as one line."""
    rows = _lines(spark, sf_dir).where("trim(text) <> ''")
    order = Window.partitionBy("document", "page").orderBy("line")
    pairs = rows.withColumn("following", F.lead("text").over(order)).where("following is not null")
    open_ones = pairs.where(~F.col("text").rlike(r"[.!?。！？:：]\s*$"))
    return open_ones.select("document", "page", "line", F.sha2(structure.joined(F.col("text"), F.col("following")), 256).alias("joined_hash"))


def quotation_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 15 signs or more that a succeeded answer quotes and none of its turn's quotes holds, white space aside."""
    rows = table(spark, sf_dir, "chat_turns").where("id is not null")
    turns = ledger.latest(rows, "id", "ingested_at", "question", "answer").where("status = 'succeeded'")
    claims = turns.select(F.col("id").alias("turn_id"), F.explode(questions.quoted(F.col("answer"))).alias("claim")).where("length(claim) >= 15")
    bare = lambda c: F.regexp_replace(c, r"[\s\p{Z}]+", "")
    held = table(spark, sf_dir, "retrieved_evidence").select("turn_id", "quote").distinct()
    # A claim meets the quotes of its own turn only, which a search returned.
    met = claims.join(held, "turn_id").where(bare(F.col("quote")).contains(bare(F.col("claim")))).select("turn_id", "claim").distinct()
    return claims.distinct().join(met, ["turn_id", "claim"], "left_anti")


def answer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their citation numbers turned into links, as hashes."""
    rows = table(spark, sf_dir, "chat_turns").where("id is not null")
    turns = ledger.latest(rows, "id", "ingested_at", "answer").where(F.col("answer").rlike(r"\[\d{1,4}\]"))
    return turns.select(F.col("id").alias("turn_id"), F.sha2(F.regexp_replace("answer", r"\[(\d{1,4})\]", "[$1](#evidence-$1)"), 256).alias("answer_hash"))


def entity_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slug of its own for each distinct title: the second of equal slugs ends on -2, and so on."""
    titles = table(spark, sf_dir, "source_nodes").select(squeeze(F.col("title")).alias("title")).where("title <> ''").distinct()
    named = titles.withColumn("slug", slug(F.col("title"), "item"))
    number = F.row_number().over(Window.partitionBy("slug").orderBy("title"))
    return named.withColumn("n", number).select("title", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("n").cast("string"))).alias("slug"))


def shortened_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest beginning of each quote of at most 20 tokens."""
    quotes = table(spark, sf_dir, "retrieved_evidence").where("quote is not null").select(F.col("evidence_revision_id").alias("id"), "quote").distinct()
    return quotes.select("id", F.length(passages.shortened_column(F.col("quote"), 20)).alias("kept"))


def span_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compositions by the number of spans that their rendering maps, and those whose spans do not fit the form from-to."""
    rows = table(spark, sf_dir, "composition_revisions").where("rendering is not null").select("draft_id", F.map_keys("rendering.span_map").alias("keys"))
    bad = F.size(F.filter("keys", lambda k: ~k.rlike(r"^\d+-\d+$")))
    return rows.groupBy(F.coalesce(F.size("keys"), F.lit(0)).alias("spans")).agg(F.countDistinct("draft_id").alias("compositions"), F.sum(bad).alias("misshapen"))


def foreign_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose statements name evidence that the turn did not retrieve, or none."""
    rows = table(spark, sf_dir, "retrieved_statements").where("turn_id is not null").select("turn_id", "statement_revision_id", "evidence_revision_ids").distinct()
    order = Window.partitionBy("turn_id").orderBy("statement_revision_id", F.array_join("evidence_revision_ids", ","))
    segments = rows.select(F.col("turn_id").alias("plan"), F.row_number().over(order).alias("ordinal"), F.col("evidence_revision_ids").alias("evidence"))
    allowed = table(spark, sf_dir, "retrieved_evidence").select(F.col("turn_id").alias("plan"), F.col("evidence_revision_id").alias("evidence"))
    return integrity.payload_problems(segments, allowed).groupBy("problem").agg(F.count("*").alias("turns"))


QUERIES = {
    f.__name__: f
    for f in (heading_kinds, page_labels, contents_entries, edge_lines, joined_lines, quotation_fidelity, answer_links, entity_slugs, shortened_quotes, span_keys, foreign_citations)
}

_LINES = r"""
WITH pages AS (SELECT doc_id AS document, unnest(string_split(text, chr(12))) AS page_text, generate_subscripts(string_split(text, chr(12)), 1) - 1 AS page FROM documents WHERE text IS NOT NULL),
lines AS (SELECT document, CAST(page AS INTEGER) AS page, unnest(string_split_regex(page_text, '\r\n|\r|\n')) AS text, CAST(generate_subscripts(string_split_regex(page_text, '\r\n|\r|\n'), 1) - 1 AS INTEGER) AS line FROM pages)
"""
_SIGNATURE = r"regexp_replace(regexp_replace(lower(trim(text, ' ')), '\d+', '#', 'g'), '\s+', ' ', 'g')"
_WIDE = r"[\x{2E80}-\x{9FFF}\x{FF00}-\x{FFEF}]"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(trim(title, ' '), '{pattern}') THEN '{name}'" for name, pattern in structure.KINDS) + " ELSE 'section' END"
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST{}, answer DESC NULLS LAST) AS rn FROM chat_turns WHERE id IS NOT NULL) WHERE rn = 1"
_PREFIX = r"(length({0}) - length(regexp_replace({0}, '[\x{{2E80}}-\x{{2FFF}}\x{{3000}}-\x{{303F}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]', '', 'g')))"

ORACLE = {
    "heading_kinds": f"SELECT title, {_KIND} AS kind FROM (SELECT DISTINCT {_SQUEEZE.format('title')} AS title FROM source_nodes) WHERE title <> ''",
    "page_labels": _LINES
    + rf"""
SELECT document, page, line, CAST(bare AS INTEGER) AS label FROM (
  SELECT *, translate(regexp_replace(regexp_replace(translate(text, '{structure.MISREAD_LETTERS}', '{structure.MISREAD_DIGITS}'), '{structure.MISREAD_NOUGHT}', '0', 'g'), '[\s\p{{Z}}]+', '', 'g'), '{structure.AROUND_NUMBERS}', '') AS bare
  FROM lines WHERE length(text) BETWEEN 1 AND 8) WHERE regexp_matches(bare, '^[0-9]{{1,4}}$')""",
    "contents_entries": f"""
WITH n AS (SELECT source_id, node_id, ordinal, min({_SQUEEZE.format('title')}) AS title FROM source_nodes WHERE source_id IS NOT NULL AND ordinal IS NOT NULL GROUP BY 1, 2, 3),
lines AS (SELECT source_id AS document, 0 AS page, CAST(row_number() OVER (PARTITION BY source_id ORDER BY ordinal, node_id) AS INTEGER) AS line, ' ' || coalesce(title, '') || ' ....... ' || ordinal AS text FROM n)"""
    + r""", e AS (SELECT document, page, line, trim(regexp_extract(text, '^\s*(.{2,120}?)\s*(?:[.·…]{2,}|\s{3,}|\t)\s*(\d{1,4})\s*$', 1), ' ') AS title,
  CAST(nullif(regexp_extract(text, '^\s*(.{2,120}?)\s*(?:[.·…]{2,}|\s{3,}|\t)\s*(\d{1,4})\s*$', 2), '') AS INTEGER) AS label FROM lines),
r AS (SELECT *, max(label) OVER (PARTITION BY document ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WHERE label IS NOT NULL)
SELECT document, page, line, title, label FROM r WHERE before IS NULL OR label >= before""",
    "edge_lines": rf"""
WITH u AS (SELECT DISTINCT source_id AS document, ordinal AS page, concat_ws(chr(10), source_title, title, text, '- ' || ordinal || ' -') AS body FROM source_units WHERE source_id IS NOT NULL AND ordinal IS NOT NULL),
lines AS (SELECT document, page, unnest(string_split_regex(body, '\r\n|\r|\n|\f')) AS text, generate_subscripts(string_split_regex(body, '\r\n|\r|\n|\f'), 1) - 1 AS line FROM u),
m AS (SELECT *, min(line) OVER (PARTITION BY document, page) AS a, max(line) OVER (PARTITION BY document, page) AS b, {_SIGNATURE} AS signature FROM lines WHERE trim(text, ' ') <> ''),
n AS (SELECT document, count(DISTINCT page) AS n FROM lines GROUP BY 1),
s AS (SELECT document, CASE WHEN line = a THEN 'top' ELSE 'bottom' END AS edge, signature, count(DISTINCT page) AS pages FROM m WHERE line = a OR line = b GROUP BY 1, 2, 3)
SELECT s.document, edge, signature, pages FROM s JOIN n USING (document) WHERE pages >= greatest(3, ceil(n * 0.2))""",
    "joined_lines": _LINES
    + rf""", p AS (SELECT *, lead(text) OVER (PARTITION BY document, page ORDER BY line) AS following FROM lines WHERE trim(text, ' ') <> '')
SELECT document, page, line, sha256(CASE WHEN regexp_matches(text, '\p{{L}}-$') AND regexp_matches(following, '^\p{{Ll}}') THEN left(text, length(text) - 1) || following
  WHEN regexp_matches(right(text, 1), '{_WIDE}') AND regexp_matches(left(following, 1), '{_WIDE}') THEN text || following ELSE text || ' ' || following END) AS joined_hash
FROM p WHERE following IS NOT NULL AND NOT regexp_matches(text, '[.!?。！？:：]\s*$')""",
    "quotation_fidelity": f"""
WITH t AS ({_LATEST.format(', question DESC NULLS LAST')}), s AS (SELECT id AS turn_id, answer AS question FROM t WHERE status = 'succeeded'),
c AS (SELECT DISTINCT turn_id, trim(unnest({_every(questions.quoted_patterns())}), ' ') AS claim FROM s),
e AS (SELECT turn_id, regexp_replace(quote, '[\\s\\p{{Z}}]+', '', 'g') AS quote FROM retrieved_evidence)
SELECT turn_id, claim FROM c WHERE length(claim) >= 15 AND NOT EXISTS (SELECT 1 FROM e WHERE e.turn_id = c.turn_id AND contains(e.quote, regexp_replace(c.claim, '[\\s\\p{{Z}}]+', '', 'g')))""",
    "answer_links": rf"""
SELECT id AS turn_id, sha256(regexp_replace(answer, '\[(\d{{1,4}})\]', '[\1](#evidence-\1)', 'g')) AS answer_hash FROM ({_LATEST.format('')}) WHERE regexp_matches(answer, '\[\d{{1,4}}\]')""",
    "entity_slugs": f"""
WITH t AS (SELECT DISTINCT {_SQUEEZE.format('title')} AS title FROM source_nodes),
s AS (SELECT title, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item-' || left(sha256(title), 12)) AS slug FROM t WHERE title <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY title) AS n FROM s)
SELECT title, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS slug FROM n""",
    "shortened_quotes": f"""
WITH q AS (SELECT DISTINCT evidence_revision_id AS id, quote FROM retrieved_evidence WHERE quote IS NOT NULL)
SELECT id, CAST(coalesce(list_max(list_filter(range(1, least(length(quote), 80) + 1), lambda n: greatest(1, {_PREFIX.format('left(quote, n)')} + (n - {_PREFIX.format('left(quote, n)')} + 3) // 4) <= 20)), 0) AS INTEGER) AS kept FROM q""",
    "span_keys": """
SELECT CAST(coalesce(len(map_keys(rendering.span_map)), 0) AS INTEGER) AS spans, count(DISTINCT draft_id) AS compositions, CAST(sum(len(list_filter(map_keys(rendering.span_map), lambda k: NOT regexp_matches(k, '^\\d+-\\d+$')))) AS BIGINT) AS misshapen
FROM composition_revisions WHERE rendering IS NOT NULL GROUP BY 1""",
    "foreign_citations": """
WITH s AS (SELECT DISTINCT turn_id, statement_revision_id, evidence_revision_ids AS e FROM retrieved_statements WHERE turn_id IS NOT NULL),
n AS (SELECT DISTINCT turn_id, unnest(e) AS e FROM s)
SELECT 'a segment without evidence' AS problem, count(DISTINCT turn_id) AS turns FROM s WHERE e IS NULL OR len(e) = 0 HAVING count(*) > 0
UNION ALL SELECT 'evidence outside the plan', count(DISTINCT turn_id) FROM n WHERE NOT EXISTS (SELECT 1 FROM retrieved_evidence r WHERE r.turn_id = n.turn_id AND r.evidence_revision_id = n.e) HAVING count(*) > 0""",
}

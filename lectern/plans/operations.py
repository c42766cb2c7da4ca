"""Operational queries over chat turns, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import is_blank
from lectern.operators import ledger
from lectern.session import table, work_folder
from lectern.streaming import ledgers

_TURN_COLUMNS = ("question", "answer", "status", "turn_no", "conversation_id")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(table(spark, sf_dir, "chat_turns").where("id is not null"), "id", "ingested_at", *_TURN_COLUMNS)


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by answer mode and status with subtotals; level 0 rows are the groups."""
    return ledger.usage_summary(_turns(spark, sf_dir), "answer_mode", "status")


def book_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums of each pinned revision with any, and their share of all."""
    sums = _turns(spark, sf_dir).groupBy("book_revision_id").agg(F.sum("total_tokens").alias("tokens")).where("tokens > 0")
    whole = sums.agg(F.sum("tokens").alias("all_tokens"))
    return sums.join(F.broadcast(whole)).select("book_revision_id", "tokens", F.round(F.col("tokens") / F.col("all_tokens"), 6).alias("share"))


def admin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals over the turns; the last day is counted back from the newest row."""
    turns = _turns(spark, sf_dir)
    newest = turns.agg(F.max("created_at").alias("newest"))
    return turns.join(F.broadcast(newest)).agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "refused").alias("refused"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin(*ledger.ACTIVE)).alias("active"),
        F.count_if(is_blank(F.col("answer"))).alias("blank_answers"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count_if(F.col("created_at") >= F.col("newest") - F.expr("interval 24 hours")).alias("last_day"),
    )


def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy("status").agg(F.count("*").alias("turns"))


def lease_queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.queue_head(_turns(spark, sf_dir)).select("id", "conversation_id", F.unix_micros("created_at").alias("created_us"))


def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns left in work, their lease judged at the time of the newest row."""
    turns = _turns(spark, sf_dir)
    now = turns.agg(F.max("ingested_at").alias("now"))
    return ledger.expired(turns.join(F.broadcast(now)), F.col("now")).select("id", "status")


def paginated_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20 of the turns whose question mentions a ledger, newest first."""
    found = _turns(spark, sf_dir).where(F.col("question").ilike("%ledger%")).select("id", "conversation_id", "status", "created_at")
    paged = ledger.page(found, [F.desc_nulls_last("created_at"), F.col("id")], 2, 20)
    return paged.select("id", "conversation_id", "status", F.unix_micros("created_at").alias("created_us"))


def audit_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).where(F.col("question").ilike("%ledger%")).agg(F.count("*").alias("total"))


def active_turn_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with turns in work, how many, and whether that is more than the one there may be."""
    active = _turns(spark, sf_dir).where(F.col("status").isin(*ledger.ACTIVE) & F.col("conversation_id").isNotNull())
    return active.groupBy("conversation_id").agg(F.count("*").alias("active")).withColumn("violated", F.col("active") > 1)


def turn_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turn numbers are not 1 to n, each once."""
    turns = _turns(spark, sf_dir).where("conversation_id is not null").groupBy("conversation_id", "turn_no").agg(F.count("*").alias("rows"))
    whole = turns.groupBy("conversation_id").agg(F.sum("rows").alias("turns"), F.count("turn_no").alias("numbers"), F.min("turn_no").alias("first"), F.max("turn_no").alias("last"))
    return whole.where(~F.coalesce((F.col("first") == 1) & (F.col("last") == F.col("turns")) & (F.col("numbers") == F.col("turns")), F.lit(False)))


def repeated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked more than once, white space and case aside."""
    key = F.trim(F.regexp_replace(F.lower("question"), r"[\s\p{Z}]+", " "))
    return _turns(spark, sf_dir).where("question is not null").groupBy(key.alias("question")).agg(F.count("*").alias("turns")).where("turns > 1")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly tumbling windows over the events (an extension: the batch twin of the stream)."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events", "value"
    )


def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens by status over all states, added up by a stream of the table's files."""
    folder = work_folder(spark)
    ledgers.usage_stream(ledgers.stream(spark, f"{sf_dir}/chat_turns.parquet"), f"{folder}/sums", f"{folder}/progress")
    return ledgers.usage_totals(spark, f"{folder}/sums")


QUERIES = {
    f.__name__: f
    for f in (
        usage_summary,
        book_tokens,
        admin_stats,
        queue_depth,
        lease_queue_head,
        expired_leases,
        paginated_audit,
        audit_total,
        active_turn_violation,
        turn_contiguity,
        repeated_questions,
        event_windows,
        usage_stream,
    )
}

_T = """WITH turn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, question DESC NULLS LAST, answer DESC NULLS LAST,
  status DESC NULLS LAST, turn_no DESC NULLS LAST, conversation_id DESC NULLS LAST) AS rn FROM chat_turns WHERE id IS NOT NULL) WHERE rn = 1)
"""
_PRICE = "(prompt_tokens * 1.0::DOUBLE + completion_tokens * 4.0::DOUBLE) / 1e6"

ORACLE = {
    "usage_summary": _T
    + f"""SELECT answer_mode, status, count(*) AS calls, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, count(*) FILTER (status = 'failed') AS failures, round(coalesce(sum({_PRICE}), 0), 6) AS cost,
  count(*) FILTER ({_PRICE} IS NULL) AS unknown_cost, grouping(answer_mode, status) AS level FROM turn GROUP BY ROLLUP (answer_mode, status)""",
    "book_tokens": _T
    + """SELECT book_revision_id, tokens, round(tokens / sum(tokens) OVER (), 6) AS share FROM (SELECT book_revision_id, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM turn GROUP BY 1) WHERE tokens > 0""",
    "admin_stats": _T
    + """SELECT count(*) AS turns, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'refused') AS refused, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status IN ('queued', 'retrieving', 'generating')) AS active, count(*) FILTER (NOT coalesce(regexp_matches(answer, '[\\p{L}\\p{N}]'), false)) AS blank_answers,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, count(*) FILTER (created_at >= (SELECT max(created_at) FROM turn) - INTERVAL 24 HOURS) AS last_day FROM turn""",
    "queue_depth": _T + "SELECT status, count(*) AS turns FROM turn GROUP BY 1",
    "lease_queue_head": _T + "SELECT id, conversation_id, epoch_us(created_at) AS created_us FROM turn WHERE status = 'queued' ORDER BY created_at NULLS LAST, id LIMIT 1",
    "expired_leases": _T
    + "SELECT id, status FROM turn WHERE status IN ('retrieving', 'generating') AND coalesce(started_at, created_at) + INTERVAL 300 SECONDS < (SELECT max(ingested_at) FROM turn)",
    "paginated_audit": _T + "SELECT id, conversation_id, status, epoch_us(created_at) AS created_us FROM turn WHERE question ILIKE '%ledger%' ORDER BY created_at DESC NULLS LAST, id LIMIT 20 OFFSET 20",
    "audit_total": _T + "SELECT count(*) AS total FROM turn WHERE question ILIKE '%ledger%'",
    "active_turn_violation": _T
    + "SELECT conversation_id, count(*) AS active, count(*) > 1 AS violated FROM turn WHERE status IN ('queued', 'retrieving', 'generating') AND conversation_id IS NOT NULL GROUP BY 1",
    "turn_contiguity": _T
    + """SELECT conversation_id, count(*) AS turns, count(DISTINCT turn_no) AS numbers, min(turn_no) AS first, max(turn_no) AS last FROM turn WHERE conversation_id IS NOT NULL GROUP BY 1
  HAVING NOT coalesce(min(turn_no) = 1 AND max(turn_no) = count(*) AND count(DISTINCT turn_no) = count(*), false)""",
    "repeated_questions": _T
    + "SELECT trim(regexp_replace(lower(question), '[\\s\\p{Z}]+', ' ', 'g')) AS question, count(*) AS turns FROM turn WHERE question IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "usage_stream": "SELECT status, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM chat_turns GROUP BY 1",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
}

"""Usage, queue and audit analytics over turn rows.

Turn rows are states: several rows may share an id.  ``latest`` keeps the newest of each by a
rank filter that also runs before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "retrieving", "generating")
TERMINAL = ("succeeded", "refused", "failed")


def latest(rows: DataFrame, key: str, when: str, *ties: str) -> DataFrame:
    """The newest row of each ``key`` by ``when``; ties by the columns ``ties``, greatest first."""
    order = Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in (when, *ties)))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def cost(prompt: Column, completion: Column, input_rate: float | None, output_rate: float | None) -> Column:
    """Price of the tokens at rates per million; null where a count or a rate is unknown."""
    if input_rate is None or output_rate is None:
        return F.lit(None).cast("double")
    return (prompt * max(0.0, input_rate) + completion * max(0.0, output_rate)) / 1e6


def usage_summary(turns: DataFrame, *by: str, input_rate: float = 1.0, output_rate: float = 4.0) -> DataFrame:
    """Calls, tokens, failures and cost by the columns ``by``, with subtotals and a grand total (nulls)."""
    priced = turns.withColumn("cost", cost(F.col("prompt_tokens"), F.col("completion_tokens"), input_rate, output_rate))
    return priced.rollup(*by).agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"),
        F.count_if(F.col("cost").isNull()).alias("unknown_cost"),
        F.grouping_id().alias("level"),
    )


def queue_head(turns: DataFrame) -> DataFrame:
    """The queued turn created first; ties by id."""
    return turns.where("status = 'queued'").orderBy(F.asc_nulls_last("created_at"), "id").limit(1)


def expired(turns: DataFrame, now: Column, lease_seconds: int = 300) -> DataFrame:
    """Turns being worked on whose lease (from their start) has run out by ``now``."""
    began = F.coalesce("started_at", "created_at")
    return turns.where(F.col("status").isin("retrieving", "generating") & (F.unix_micros(began) + lease_seconds * 1_000_000 < F.unix_micros(now)))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, 1 to 200, in a total order."""
    size = min(max(size, 1), 200)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def capped(events: DataFrame, key: str, order: list[Column], cap: int = 256) -> DataFrame:
    """The first ``cap`` events of each key, and how many more there were in ``dropped``."""
    window = Window.partitionBy(key)
    numbered = events.withColumn("_n", F.row_number().over(window.orderBy(*order)))
    sizes = events.groupBy(key).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("dropped"))
    return numbered.where(F.col("_n") <= cap).drop("_n").join(sizes, key)

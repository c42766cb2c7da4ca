"""Streaming twins: usage ledgers, incremental indexes and leases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.sources.sinks import folder_names


def stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A parquet table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may be a folder of files or one file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def usage_stream(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Adds up calls and tokens by status, a file of partial sums per batch; runs to the end of input.

    A batch that is repeated after a failure overwrites its own partial sums, so each row counts once."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("status").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.select("status", "total_tokens").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def usage_totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("status").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))


def windowed_events(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Tumbling windows of events by type, closed ``late`` after the newest event seen."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def incremental_index(chapters: DataFrame, index: str, checkpoint: str, make) -> None:
    """Indexes the changed chapters of a stream of (source_path, chapter, text) and no others.

    ``make`` turns chapters into chunks.  Each batch writes the hashes and the chunks of the chapters whose
    text differs from the one last indexed; ``indexed`` reads of each path what the last batch wrote, so a
    changed chapter replaces its chunks, one that loses its text has none, and one changed back is
    indexed again.  Batches are numbered on, whatever stream they come from; one that is repeated after a
    failure keeps its number and writes its rows anew.  Of several texts of a path in one batch the
    greatest stands."""
    stream_name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = sorted(n.removeprefix("batch=") for n in folder_names(spark, f"{index}/state") if n.startswith("batch="))
        own = next((n for n in known if n.endswith(f".{stream_name}.{number}")), None)
        name = own or f"{int(known[-1].split('.')[0]) + 1 if known else 0:012d}.{stream_name}.{number}"
        newest = batch.where("source_path is not null").groupBy("source_path").agg(F.max(F.struct("text", "chapter")).alias("c")).select("source_path", "c.chapter", "c.text")
        rows = newest.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
        if known:
            earlier = spark.read.schema(_STATE).parquet(f"{index}/state").where(F.col("batch") < name)
            last = earlier.groupBy("source_path").agg(F.max_by("text_hash", "batch").alias("text_hash"))
            rows = rows.join(last, ["source_path", "text_hash"], "left_anti")
        rows = rows.persist()
        # The chunks first: a batch counts from when its state is written.
        make(rows.where("text is not null").select("source_path", "chapter", "text")).write.mode("overwrite").parquet(f"{index}/chunks/batch={name}")
        rows.select("source_path", "text_hash").write.mode("overwrite").parquet(f"{index}/state/batch={name}")
        rows.unpersist()

    chapters.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


_STATE = "source_path string, text_hash string, batch string"


def indexed(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of an index of ``incremental_index``: of each path those of its last batch."""
    last = spark.read.schema(_STATE).parquet(f"{index}/state").groupBy("source_path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{index}/chunks").withColumn("batch", F.col("batch").cast("string")).join(last, ["source_path", "batch"], "left_semi").drop("batch")


LEASE_STATE = "owner string, attempt int, until bigint, done boolean"


def leases(events: DataFrame, seconds: int = 300) -> DataFrame:
    """The state of each job in a stream of (job, owner, action, at): who holds it, by which attempt.

    ``claim`` takes a job that is free or whose lease has run out; ``renew`` and ``finish`` count only
    from the owner while the lease lasts; anything else is rejected."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, attempt, until, done = state.get if state.exists else (None, 0, 0, False)
        out = []
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "owner"])
        for event in rows.itertuples():
            now, good = int(event.at.timestamp()), False
            if event.action == "claim" and not done and (owner is None or until < now):
                owner, attempt, until, good = event.owner, attempt + 1, now + seconds, True
            elif event.owner == owner and not done and until >= now and event.action in ("renew", "finish"):
                until, done, good = now + max(1, seconds), event.action == "finish", True
            out.append((key[0], event.owner, event.action, attempt, good, done))
        state.update((owner, attempt, until, done))
        yield pd.DataFrame(out, columns=["job", "owner", "action", "attempt", "accepted", "done"])

    return events.groupBy("job").applyInPandasWithState(
        step, "job string, owner string, action string, attempt int, accepted boolean, done boolean", LEASE_STATE, "append", GroupStateTimeout.NoTimeout
    )

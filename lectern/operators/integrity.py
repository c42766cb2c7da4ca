"""Checks and re-use: exact keys, answer payloads, citations, checkpoints, what a change makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_problems(value: Column, wanted: list[str]) -> Column:
    """Missing and extra keys of a map, as sorted text; empty if they are exactly ``wanted``."""
    keys, need = F.map_keys(value), F.array(*map(F.lit, wanted))
    missing = F.transform(F.array_sort(F.array_except(need, keys)), lambda k: F.concat(F.lit("missing "), k))
    extra = F.transform(F.array_sort(F.array_except(keys, need)), lambda k: F.concat(F.lit("extra "), k))
    return F.concat(missing, extra)


def payload_problems(segments: DataFrame, allowed: DataFrame) -> DataFrame:
    """(plan, problem) of answers: ``segments(plan, ordinal, evidence array)``, ``allowed(plan, evidence)``.

    Ordinals are 1 to n, each once; a segment names some evidence, all of it allowed to the plan."""
    order = segments.groupBy("plan").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b"))
    broken = order.where("d <> n or a <> 1 or b <> n").select("plan", F.lit("segments are not numbered 1 to n").alias("problem"))
    bare = segments.where("evidence is null or size(evidence) = 0").select("plan", F.lit("a segment without evidence").alias("problem"))
    named = segments.select("plan", F.explode("evidence").alias("evidence"))
    foreign = named.join(allowed.select("plan", "evidence").distinct(), ["plan", "evidence"], "left_anti").select("plan", F.lit("evidence outside the plan").alias("problem"))
    return broken.unionByName(bare).unionByName(foreign).distinct()


def reusable(wanted: DataFrame, done: DataFrame, *hashes: str) -> DataFrame:
    """The nodes of ``wanted(node, *hashes)`` that ``done`` holds with the same hashes and status succeeded."""
    return wanted.join(done.where("status = 'succeeded'").select("node", *hashes), ["node", *hashes], "left_semi")


def stale(changed: DataFrame, below: DataFrame) -> DataFrame:
    """(node): the changed nodes and everything that depends on them, near or far.

    ``below(node, descendant)`` as of ``hierarchy.reachable``, ``descendant`` depending on ``node``."""
    return changed.select("node").unionByName(below.join(changed.select("node"), "node").select(F.col("descendant").alias("node"))).distinct()


def removed_and_added(old: DataFrame, new: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """What only ``old`` and what only ``new`` has, by set semantics on ``keys``."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti"), b.join(a, list(keys), "left_anti")


def missing_numbers(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number): what is missing of 1 to the group's greatest number."""
    held = rows.where(F.col(number) > 0).select(group, number).distinct()
    every = held.groupBy(group).agg(F.max(number).alias("m")).select(group, F.explode(F.sequence(F.lit(1), "m")).alias(number))
    return every.join(held, [group, number], "left_anti")

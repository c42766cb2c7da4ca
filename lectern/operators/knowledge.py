"""Support closure, coverage decisions, conflicts and grounding of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.terms import token_set

# Least scores of a composition, statement and evidence to be used, and statements used at most.
LEAST = {"composition": 0.35, "statement": 0.2, "evidence": 0.15}
SELECTED = 6
# Words that negate a statement.
NEGATIONS = ("不", "非", "没有", "never", "not", "no")


def support_closure(edges: DataFrame) -> DataFrame:
    """(statement, evidence, positive): edges of several kinds merged, positive if any of them is."""
    return edges.groupBy("statement", "evidence").agg(F.bool_or("positive").alias("positive"))


def conflicts(statements: DataFrame, group: str) -> DataFrame:
    """(group, a, b): pairs of selected statements that share three tokens, one of them negated.

    ``statements(group, id, text, place)``; ``place`` is at most ``SELECTED``, so a group has 15 pairs."""
    words = F.array_except(token_set(F.col("text")), F.array(*map(F.lit, NEGATIONS)))
    negated = F.arrays_overlap(token_set(F.col("text")), F.array(*map(F.lit, NEGATIONS)))
    rows = statements.where(F.col("place") <= SELECTED).select(group, "id", "place", words.alias("w"), negated.alias("neg"))
    pair = F.inline(
        F.flatten(
            F.transform(
                "s",
                lambda x: F.transform(
                    F.filter("s", lambda y: (x["place"] < y["place"]) & (x["neg"] != y["neg"]) & (F.size(F.array_intersect(x["w"], y["w"])) >= 3)),
                    lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")),
                ),
            )
        )
    )
    return rows.groupBy(group).agg(F.collect_list(F.struct("id", "place", "w", "neg")).alias("s")).select(group, pair)


def coverage(analysis: DataFrame, statements: DataFrame, compositions: DataFrame, evidence: DataFrame) -> DataFrame:
    """How each turn can be answered from its hits, and why.

    ``analysis(turn_id, terms, exact, overview, several, wide)``: quoted terms; whether the exact wording is
    asked for, a composition will do, two pieces at least are needed, the whole book is meant.
    ``statements(turn_id, id, score, text)``, ``compositions(turn_id, score, text)``, ``evidence(turn_id, score, quote)``.

    Statements count as far as they are selected (the ``SELECTED`` best); two of them that contradict each
    other leave neither compositions nor statements as an answer."""
    known = statements.where(F.col("score") >= LEAST["statement"])
    selected = placed(known, "turn_id", F.desc("score"), F.col("id")).where(F.col("place") <= SELECTED)
    clash = conflicts(selected, "turn_id").select("turn_id").distinct().withColumn("conflict", F.lit(True))
    s = statements.groupBy("turn_id").agg(F.least(F.count_if(F.col("score") >= LEAST["statement"]), F.lit(SELECTED)).alias("n_statements"), F.max("score").alias("statement_max"))
    usable = (F.col("score") >= LEAST["composition"]) & (F.trim("text") != "")
    c = compositions.groupBy("turn_id").agg(F.count_if(usable).alias("n_compositions"), F.max("score").alias("composition_max"))
    named = F.forall("terms", lambda t: F.contains(F.lower("quote"), F.lower(t)))
    fits = F.when(F.col("exact") & (F.size("terms") > 0), named).otherwise(F.col("score") >= LEAST["evidence"])
    e = evidence.join(analysis.select("turn_id", "terms", "exact"), "turn_id").groupBy("turn_id").agg(F.count_if(fits).alias("n_evidence"), F.max("score").alias("evidence_max"))
    rows = analysis.join(s, "turn_id", "left").join(c, "turn_id", "left").join(e, "turn_id", "left").join(clash, "turn_id", "left")
    rows = rows.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_statements", "n_compositions", "n_evidence")})
    rows = rows.withColumns({n: F.round(F.coalesce(n, F.lit(0.0)), 6) for n in ("statement_max", "composition_max", "evidence_max")})
    rows = rows.withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    composed = ~F.col("exact") & F.col("overview") & (F.col("n_compositions") > 0)
    few, thin = F.col("several") & (F.col("n_statements") < 2), F.col("wide") & (F.col("n_statements") < 2) & ~composed
    rows = rows.withColumns(
        {
            "canonical_complete": composed & ~F.col("conflict"),
            "knowledge_complete": (F.col("n_statements") > 0) & ~few & ~thin & ~F.col("conflict"),
            "raw_complete": (F.col("n_evidence") > 0) & ~(F.col("several") & (F.col("n_evidence") < 2)),
        }
    )
    by_statements = F.col("knowledge_complete") & ~F.col("exact")
    mode = F.when(F.col("canonical_complete"), "canonical_passthrough").when(by_statements, "knowledge_synthesis").otherwise("raw_synthesis")
    enough = F.col("canonical_complete") | F.col("knowledge_complete") | F.col("raw_complete")
    # The names of the reasons.
    reasons = F.array(
        F.when(few, "relation_requires_multiple_knowledge_nodes"),
        F.when(thin, "cross_scope_knowledge_is_incomplete"),
        F.when(F.col("conflict"), "knowledge_conflict_detected"),
        F.when(F.col("canonical_complete"), "complete_canonical_composition").when(by_statements, "positive_knowledge_closure").otherwise("raw_evidence_required"),
        F.when(~enough, "insufficient_pinned_evidence"),
    )
    return rows.select(
        "turn_id", mode.alias("answer_mode"), enough.alias("sufficient"), "canonical_complete", "knowledge_complete", "raw_complete", "conflict", F.array_compact(reasons).alias("reasons"), "statement_max", "composition_max", "evidence_max"
    )


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def ungrounded(claims: DataFrame, sources: DataFrame, group: str) -> DataFrame:
    """(group, claim): claimed strings that no source text of their group contains.

    Claims and sources meet by an equi-join on (group, token), the token being the claim itself for
    numbers and dates; nothing is compared pair by pair."""
    return claims.select(group, "claim").distinct().join(sources.select(group, "claim").distinct(), [group, "claim"], "left_anti")

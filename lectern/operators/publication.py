"""From drafts to what is published: resolution, supersession, answer plans, citations, embedded layers.

Everything is content-addressed: an id is a hash of what it names, so that equal content has equal ids
and a repeated run adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 32 hexadecimal digits of the hash of ``parts``, arrays joined by commas; null counts as empty."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256), F.lit(32)))


def resolve(members: DataFrame, revisions: DataFrame) -> DataFrame:
    """``members(owner, ordinal, draft, revision)`` with ``resolved``, the member's revision, and ``how`` it was found:
    ``given`` with the member, ``looked up`` by its draft in ``revisions(draft, found)``, or ``unknown``."""
    known = revisions.groupBy("draft").agg(F.max("found").alias("found"))
    how = F.when(F.col("revision").isNotNull(), "given").when(F.col("found").isNotNull(), "looked up").otherwise("unknown")
    return members.join(known, "draft", "left").select("owner", "ordinal", "draft", F.coalesce("revision", "found").alias("resolved"), how.alias("how"))


def superseded(revisions: DataFrame, *key: str) -> DataFrame:
    """``revisions(..., id, created_at)`` with ``status``: healthy for the newest of each key, else superseded.

    The newest is found by an aggregate and joined back, so a key of any size spreads over tasks."""
    newest = revisions.groupBy(*key).agg(F.max(F.struct("created_at", "id")).alias("_newest"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}"))
    joined = revisions.alias("r").join(newest.alias("n"), same)
    status = F.when(F.struct("r.created_at", "r.id").eqNullSafe(F.col("n._newest")), "healthy").otherwise("superseded")
    return joined.select("r.*", status.alias("status"))


def answer_plans(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(turn_id, plan_id, statements, evidence): what an answer may rest on, its ids sorted and each once.

    ``statements(turn_id, id)``, ``evidence(turn_id, id)``.  The plan's id is the hash of both lists."""
    parts = statements.select("turn_id", F.lit("s").alias("kind"), "id").unionByName(evidence.select("turn_id", F.lit("e").alias("kind"), "id"))
    lists = parts.distinct().groupBy("turn_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id")))).alias(name) for k, name in (("s", "statements"), ("e", "evidence"))))
    return lists.select("turn_id", content_id("plan-", F.array_join("statements", ","), F.array_join("evidence", ",")).alias("plan_id"), "statements", "evidence")


def citations(evidence: DataFrame) -> DataFrame:
    """(turn_id, number, id, quote_hash): the evidence of a turn by score, each piece once, numbered from 1.

    ``evidence(turn_id, id, quote, score)``; of equal pieces the best-scored stands."""
    once = evidence.groupBy("turn_id", "id").agg(F.max("score").alias("score"), F.max("quote").alias("quote"))
    order = Window.partitionBy("turn_id").orderBy(F.desc_nulls_last("score"), "id")
    return once.select("turn_id", F.row_number().over(order).alias("number"), "id", F.sha2("quote", 256).alias("quote_hash"))


# --- layers of documents with vectors


def shape_embedder(text: Column) -> Column:
    """A vector of three numbers that depend on a text's length and its first and last sign: no meaning, but
    always the same, for tests and for running without a model."""
    given = F.coalesce(text, F.lit(""))
    first, last = F.ascii(given), F.ascii(F.right(given, F.lit(1)))
    return F.array(*((F.pmod(x, F.lit(m)) + 1).cast("float") for x, m in ((F.length(given), 7), (first, 11), (last, 13))))


#: Embedders by name: a function from a text column to a column of arrays of floats.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"shape": shape_embedder}


def embedder(name: str) -> Callable[[Column], Column]:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {name}")
    return EMBEDDERS[name]


def index_layers(layers: dict[str, DataFrame], name: str = "shape") -> DataFrame:
    """(layer, document_id, text_hash, identity, vector) of ``layers`` of (document_id, text); blank texts are left out."""
    rows = None
    for layer, documents in layers.items():
        part = documents.where(F.trim("text") != "").groupBy("document_id").agg(F.max("text").alias("text")).select(F.lit(layer).alias("layer"), "document_id", "text")
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("layer", "document_id", F.sha2("text", 256).alias("text_hash"), F.lit(name).alias("identity"), embedder(name)(F.col("text")).alias("vector"))


def layer_health(expected: DataFrame, index: DataFrame) -> DataFrame:
    """(layer, expected, indexed, missing, extra, changed): documents of ``expected(layer, document_id, text_hash)``
    against those of an index; changed ones are in both with another text."""
    a = expected.select("layer", "document_id", F.col("text_hash").alias("_want")).distinct()
    b = index.select("layer", "document_id", F.col("text_hash").alias("_have")).distinct()
    both = a.join(b, ["layer", "document_id"], "full")
    want, have = F.col("_want").isNotNull(), F.col("_have").isNotNull()
    return both.groupBy("layer").agg(
        F.count_if(want).alias("expected"), F.count_if(have).alias("indexed"), F.count_if(want & ~have).alias("missing"), F.count_if(have & ~want).alias("extra"), F.count_if(F.col("_want") != F.col("_have")).alias("changed")
    )


def layer_reuse(expected: DataFrame, index: DataFrame, identity: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``index`` that can stay, and the rows of ``expected`` that must be embedded anew."""
    usable = index.where(F.col("identity") == identity)
    keys = ["layer", "document_id", "text_hash"]
    return usable.join(expected.select(*keys), keys, "left_semi"), expected.join(usable.select(*keys), keys, "left_anti")

import pytest
from pyspark.sql import functions as F

from lectern.operators import publication as p


def test_members_are_resolved_by_draft(spark):
    members = spark.createDataFrame([("o", 0, "d1", "r0"), ("o", 1, "d1", None), ("o", 2, "d9", None), ("o", 3, None, None)], "owner string, ordinal int, draft string, revision string")
    revisions = spark.createDataFrame([("d1", "r1"), ("d1", "r2"), (None, "r3")], "draft string, found string")
    got = {r.ordinal: (r.resolved, r.how) for r in p.resolve(members, revisions).collect()}
    assert got == {0: ("r0", "given"), 1: ("r2", "looked up"), 2: (None, "unknown"), 3: (None, "unknown")}


def test_only_the_newest_of_a_key_stands(spark):
    rows = spark.createDataFrame([("a", "k", 1), ("b", "k", 2), ("c", None, 1), ("d", None, None), ("e", "k", 2)], "id string, key string, created_at int")
    assert {r.id: r.status for r in p.superseded(rows, "key").collect()} == {"a": "superseded", "b": "superseded", "e": "healthy", "c": "healthy", "d": "superseded"}
    assert p.superseded(rows.limit(0), "key").count() == 0


def test_plans_depend_on_content_only(spark):
    one = spark.createDataFrame([("t", "s2"), ("t", "s1"), ("t", "s1"), ("u", "s1"), ("u", "s2")], "turn_id string, id string")
    evidence = spark.createDataFrame([("t", "e"), ("u", "e"), ("v", "e")], "turn_id string, id string")
    got = {r.turn_id: r for r in p.answer_plans(one, evidence).collect()}
    assert got["t"].plan_id == got["u"].plan_id != got["v"].plan_id and got["t"].statements == ["s1", "s2"] and got["v"].statements == []


def test_citations_are_numbered_once(spark):
    rows = spark.createDataFrame([("t", "a", "q", 1.0), ("t", "b", "r", 2.0), ("t", "a", "q", 3.0), ("t", "c", None, None)], "turn_id string, id string, quote string, score double")
    assert [(r.number, r.id) for r in p.citations(rows).orderBy("number").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_layers_health_and_reuse(spark):
    docs = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", " "), ("d", None)], "document_id string, text string")
    index = p.index_layers({"x": docs, "y": docs.where("document_id = 'a'")})
    assert index.count() == 3 and {len(r.vector) for r in index.collect()} == {3}
    old = p.index_layers({"x": docs.withColumn("text", F.when(F.col("document_id") == "a", "other").otherwise(F.col("text"))), "z": docs})
    health = {r.layer: tuple(r)[1:] for r in p.layer_health(index, old).collect()}
    assert health == {"x": (2, 2, 0, 0, 1), "y": (1, 0, 1, 0, 0), "z": (0, 2, 0, 2, 0)}
    kept, new = p.layer_reuse(index, old, "shape")
    assert [(r.layer, r.document_id) for r in kept.collect()] == [("x", "b")] and sorted((r.layer, r.document_id) for r in new.collect()) == [("x", "a"), ("y", "a")]
    assert p.layer_reuse(index, old, "another")[0].count() == 0
    with pytest.raises(ValueError):
        p.embedder("unknown")

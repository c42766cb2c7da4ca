from pyspark.sql import functions as F

from lectern.operators import knowledge, ledger, questions


def test_quoted_passages_and_chapters(spark):
    asked = ["Was heißt „die Küste“ in Kapitel 3 und Kapitel 12?", '第2章中原文说"知识必须有据"，第 2 章', "chap. 7 says “a b” and “a b” and “ ”", "nothing", "", None]
    df = spark.createDataFrame([(q,) for q in asked], "q string").select(questions.quoted(F.col("q")), questions.chapters(F.col("q")))
    assert [tuple(r) for r in df.collect()] == [(["die Küste"], [3, 12]), (["知识必须有据"], [2]), (["a b"], [7]), ([], []), ([], []), ([], [])]


def test_coverage_modes(spark):
    analysis = "turn_id string, terms array<string>, exact boolean, overview boolean, several boolean, wide boolean"
    asked = [(t, [], False, t != "b", t == "b", False) for t in "abcdefg"] + [("h", ["Coast"], True, True, False, False)]
    statements = [("b", "1", 0.9, "x"), ("b", "2", 0.3, "y"), ("c", "1", 0.1, "x")]
    # e and f hold a statement and its denial; in f they are six places apart, and only six are selected
    statements += [(t, "1", 0.9, "the map shows the coast") for t in "ef"] + [(t, "9", 0.5, "the map never shows the coast") for t in "ef"]
    statements += [("f", str(k), 0.8, "other words") for k in range(2, 8)] + [("g", "1", None, "the map")]
    rows = knowledge.coverage(
        spark.createDataFrame(asked, analysis),
        spark.createDataFrame(statements, "turn_id string, id string, score double, text string"),
        spark.createDataFrame([("a", 0.5, "text"), ("c", 0.9, " "), ("e", 0.9, "text")], "turn_id string, score double, text string"),
        spark.createDataFrame([("c", 0.5, "quote"), ("h", 0.0, "the coast"), ("e", 0.5, "q")], "turn_id string, score double, quote string"),
    )
    got = {r.turn_id: (r.answer_mode, r.sufficient, r.conflict) for r in rows.collect()}
    assert got == {
        "a": ("canonical_passthrough", True, False), "b": ("knowledge_synthesis", True, False), "c": ("raw_synthesis", True, False), "d": ("raw_synthesis", False, False),
        "e": ("raw_synthesis", True, True), "f": ("knowledge_synthesis", True, False), "g": ("raw_synthesis", False, False), "h": ("raw_synthesis", True, False),
    }
    reasons = {r.turn_id: r.reasons for r in rows.collect()}
    assert reasons["e"] == ["knowledge_conflict_detected", "raw_evidence_required"] and reasons["d"] == ["raw_evidence_required", "insufficient_pinned_evidence"]


def test_conflicts_and_closure(spark):
    rows = spark.createDataFrame([("t", "a", "the map shows the coast", 1), ("t", "b", "the map never shows the coast", 2), ("t", "c", "other words", 3)], "turn_id string, id string, text string, place int")
    assert [tuple(r) for r in knowledge.conflicts(rows, "turn_id").collect()] == [("t", "a", "b")]
    edges = spark.createDataFrame([("s", "e", False), ("s", "e", True)], "statement string, evidence string, positive boolean")
    assert knowledge.support_closure(edges).first().positive


def test_ledger(spark):
    rows = spark.createDataFrame([("a", 1, "queued", 5, None), ("a", 2, "succeeded", 5, 7), ("b", None, "failed", None, None), ("b", 1, "failed", 1, 1)], "id string, at int, status string, prompt_tokens int, completion_tokens int")
    newest = ledger.latest(rows, "id", "at")
    assert {r.id: r.status for r in newest.collect()} == {"a": "succeeded", "b": "failed"}
    total = ledger.usage_summary(newest.withColumn("total_tokens", F.lit(1)), "status").where("level = 1").first()
    assert total.calls == 2 and total.failures == 1 and total.cost == round((5 + 28 + 1 + 4) / 1e6, 6)
    assert ledger.page(rows, [F.col("at"), F.col("id")], 1, 500).count() == 4
    assert {r.dropped for r in ledger.capped(rows, "id", [F.col("at")], 1).collect()} == {1}

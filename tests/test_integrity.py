import pytest
from pyspark.sql import functions as F

from lectern.functions import labels
from lectern.operators import integrity as i


def test_json_contracts(spark):
    assert labels.strict_object('{"a": [1]}') == {"a": [1]}
    for bad in ("[1]", '{"a": 1, "a": 2}', '{"a": 1} x', "", "{"):
        with pytest.raises(labels.ContractError):
            labels.strict_object(bad)
    assert labels.repaired_object('```json\n{"a": 1,\n "b": [2,],}\n```') == {"a": 1, "b": [2]}
    assert labels.repaired_object('Sure: {"a": 1\n"b": 2} done') == {"a": 1, "b": 2}
    df = spark.createDataFrame([('{"a": 1}',), ("[]",), (None,)], "t string")
    assert [r[0] for r in df.select(labels.is_strict_object(F.col("t"))).collect()] == [True, False, False]
    assert spark.createDataFrame([("é",)], "t string").select(labels.normal_form(F.col("t"))).first()[0] == "é"


def test_slugs(spark):
    df = spark.createDataFrame([("The Map’s  Corner!",), ("海岸",), (None,)], "t string")
    got = [r[0] for r in df.select(labels.slug(F.col("t"), "unit")).collect()]
    assert got[0] == "the-map-s-corner" and got[1].startswith("unit-") and len(got[1]) == 17 and got[2] != got[1]


def test_folded_slugs(spark):
    df = spark.createDataFrame([("Café Über  №5",), ("ﬁne – Été",), ("海岸",)], "t string")
    got = [r[0] for r in df.select(labels.slug(F.col("t"), "unit", fold=True)).collect()]
    assert got[:2] == ["cafe-uber-no5", "fine-ete"] and got[2].startswith("unit-")


def test_keys_payloads_and_reuse(spark):
    df = spark.createDataFrame([({"a": 1, "c": 2},), ({"a": 1, "b": 1},)], "m map<string,int>")
    assert [r[0] for r in df.select(i.key_problems(F.col("m"), ["a", "b"])).collect()] == [["missing b", "extra c"], []]
    segments = spark.createDataFrame([("p", 1, ["e"]), ("p", 2, ["x"]), ("q", 2, []), ("r", 1, ["e"])], "plan string, ordinal int, evidence array<string>")
    allowed = spark.createDataFrame([("p", "e"), ("r", "e")], "plan string, evidence string")
    got = {(r.plan, r.problem) for r in i.payload_problems(segments, allowed).collect()}
    assert {p for p, _ in got} == {"p", "q"} and len(got) == 3
    done = spark.createDataFrame([("n", "h1", "succeeded"), ("m", "h2", "failed")], "node string, input_hash string, status string")
    assert [r.node for r in i.reusable(done.select("node", "input_hash"), done, "input_hash").collect()] == ["n"]
    below = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "node string, descendant string")
    assert {r.node for r in i.stale(spark.createDataFrame([("b",)], "node string"), below).collect()} == {"b", "c"}
    rows = spark.createDataFrame([("g", 1), ("g", 4), ("h", 0), ("h", None)], "g string, n int")
    assert {(r.g, r.n) for r in i.missing_numbers(rows, "g", "n").collect()} == {("g", 2), ("g", 3)}

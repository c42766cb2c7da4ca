import math
import random
from statistics import median

from lectern.llm import ranking as r

SCORES = "turn string, kind string, item string, channel string, score double"


def brute(rows, weights):
    """{turn: items, best first} and the fused scores, in plain Python."""
    z = {}
    for turn, channel in {(x[0], x[3]) for x in rows}:
        known = [x for x in rows if (x[0], x[3]) == (turn, channel) and x[4] is not None and not math.isnan(x[4])]
        if not known:
            continue
        m = median(x[4] for x in known)
        mad = median(abs(x[4] - m) for x in known)
        scale = 1.4826 * mad if mad else 1.2533 * sum(abs(x[4] - m) for x in known) / len(known)
        for x in known:
            z[x[:4]] = round((x[4] - m) / scale, 9) if x[4] != m else 0.0
    fused = {}
    for item in {x[:3] for x in rows}:
        got = [(weights.get(k[3], 1.0), v) for k, v in z.items() if k[:3] == item]
        if got:
            w = sum(a for a, _ in got)
            fused[item] = (math.exp(sum(a * -math.log1p(math.exp(-b)) for a, b in got) / w), sum(a * b for a, b in got) / w)
    ranked = {}
    for item in sorted({x[:3] for x in rows}, key=lambda i: (i[0], i not in fused, *((-round(fused[i][0], 12), -round(fused[i][1], 8)) if i in fused else (0, 0)), i[1], i[2])):
        ranked.setdefault(item[0], []).append(item[1:])
    return ranked, fused


def check(spark, rows, weights):
    df = spark.createDataFrame(rows, SCORES)
    out = r.rank(r.fuse(df, "turn", weights), "turn").collect()
    ranked, fused = brute(rows, weights)
    got = {}
    for row in sorted(out, key=lambda x: (x.turn, x.rank)):
        got.setdefault(row.turn, []).append((row.kind, row["item"]))
        want = fused.get((row.turn, row.kind, row["item"]))
        assert (row.fused is None) == (want is None) and (want is None or abs(row.fused - want[0]) < 1e-9)
    assert got == ranked


def test_against_brute_force_with_one_hot_group(spark):
    dice = random.Random(5)
    rows = [("hot", dice.choice("ab"), f"i{k}", None, round(dice.gauss(0, 9), 1)) for k in range(300)]
    rows += [(f"t{k % 9}", dice.choice("abc"), f"j{k}", None, dice.gauss(5, 1) if k % 7 else None) for k in range(120)]
    check(spark, [(t, k, i, k, s) for t, k, i, _, s in rows], {})


def test_several_scores_ties_nan_and_outliers(spark):
    rows = [
        ("t", "a", "x", "a", 1.0), ("t", "a", "y", "a", 1.0), ("t", "a", "z", "a", 1.0), ("t", "a", "z", "b", 9.0),
        ("t", "b", "q", "b", 1e6), ("t", "b", "p", "b", -3.0), ("t", "b", "n", "b", float("nan")), ("t", "b", "o", "b", 0.0),
        ("u", "a", "x", "a", None), ("v", "a", "only", "a", 4.0),
    ]
    check(spark, rows, {"b": 0.5})


def test_no_channel_wins_by_its_range(spark):
    rows = [("t", "small", f"s{k}", "small", k / 100) for k in range(9)] + [("t", "large", f"l{k}", "large", 1000.0 * k) for k in range(9)]
    best = r.rank(r.fuse(spark.createDataFrame(rows, SCORES), "turn", {}), "turn").where("rank <= 6").collect()
    assert sorted(x.kind for x in best) == ["large"] * 3 + ["small"] * 3


def test_empty_and_infinite(spark):
    assert r.rank(r.fuse(spark.createDataFrame([], SCORES), "turn", {}), "turn").count() == 0
    rows = [("t", "a", x, "a", v) for x, v in (("p", float("inf")), ("q", 1.0), ("r", 2.0), ("s", 3.0), ("m", float("-inf")))]
    out = {x["item"]: x for x in r.rank(r.fuse(spark.createDataFrame(rows, SCORES), "turn", {}), "turn").collect()}
    assert out["p"].rank == 1 and out["m"].rank == 5 and out["p"].fused == 1.0


def test_hits_keep_the_latest_row_once(spark, tmp_path):
    for name, key in r.CHANNELS.values():
        rows = [("t", "h", "1.0", "2024-01-01"), ("t", "h", "2.0", "2024-01-02"), ("t", "h", "2.0", "2024-01-02"), (None, "h", "1.0", None), ("t", None, "1.0", None)]
        df = spark.createDataFrame(rows, f"turn_id string, {key} string, score string, d string").selectExpr("turn_id", key, "cast(score as double) score", "cast(d as timestamp) retrieved_at", "'k' kind", "1 _at", "array() evidence_revision_ids")
        df.withColumn("evidence_revision_ids", df.evidence_revision_ids.cast("array<string>")).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted((x.record, x.hit_id, x["rank"]) for x in r.p1_ranking(spark, str(tmp_path)).collect()) == [("composition", "h", 1), ("evidence", "h", 2), ("statement", "h", 3)]
    assert r.p1_ranking_supported(spark, str(tmp_path)).count() == 3

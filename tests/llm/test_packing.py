import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing, packing, tokens

ITEMS = "doc_id bigint, tokens bigint, container_id string, left bigint"


def test_everything_is_placed_once_and_nothing_overflows(spark):
    dice = random.Random(4)
    rows = [(k, dice.choice([0, 3, 40, 90, 100, 101, 250, 1000]), "x", 1) for k in range(400)] + [(7000, 300, "x", 1)] * 2 + [(None, 7, "x", 1), (5, 40, "x", 1), (6, None, "x", 1)]
    df = spark.createDataFrame(rows, ITEMS)
    out = packing.pack(df, {"a": 100, "b": 300, "none": 0}, partitions=5).cache()
    sizes = df.groupBy("doc_id").agg(F.sum("tokens").alias("want"))
    placed = out.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("got"), F.count("*").alias("n"))
    assert placed.join(sizes, placed.doc_id.eqNullSafe(sizes.doc_id)).where(~F.col("got").eqNullSafe(F.coalesce("want", F.lit(0)))).count() == 0
    assert placed.groupBy("container_kind").count().collect()[0]["count"] == sizes.count()
    full = out.groupBy("container_kind", "container_id", "capacity").agg(F.sum("tokens").alias("used"))
    assert full.where("used > capacity").count() == 0
    split = out.where("piece > 0").select("doc_id", "capacity").distinct().join(df, "doc_id")
    assert split.where("tokens <= capacity").count() == 0
    assert full.groupBy("container_kind").agg((F.sum("used") / F.sum("capacity")).alias("fill")).where("fill < 0.93").count() == 0
    assert out.count() == out.select("container_kind", "container_id", "doc_id", "piece", "tokens").count()


def test_empty_items(spark):
    assert packing.pack(spark.createDataFrame([], ITEMS), {"a": 10}).count() == 0
    only = packing.pack(spark.createDataFrame([(1, 0, "", 0), (2, 0, "", 0)], ITEMS), {"a": 10})
    assert only.select("container_id").distinct().count() == 1


def test_shelf_is_best_fit_and_bounded():
    shelf = packing.Shelf(10, 2)
    assert [shelf.place(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0]
    assert [shelf.place(s) for s in (9, 8, 2)] == [2, 3, 3]
    assert len(shelf.free) == 2


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "the map of the coast"), (2, ""), (3, None), (4, "残破的索引" * 1000)], "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df).collect()}
    assert got[2] == got[3] == 0 and 4 <= got[1] <= 8 and got[4] > 1000


def test_slots_meet_shares_and_caps():
    totals = mixing.slot_totals({"a": 51200, "b": 25600, "c": 0}, {"a": (0.5, 2), "b": (0.5, 1), "c": (0.2, 9), "d": (None, 1)})
    assert totals == {"a": 50, "b": 50}
    # 513 tokens are two blocks of 256 or 257, not one of 512 and one of 1
    assert mixing.slot_totals({"a": 513, "b": 10**6}, {"a": (0.1, 3), "b": (0.9, 1)}) == {"a": 6, "b": 27}
    assert mixing.slot_totals({}, {"a": (1.0, 1)}) == {}


def test_shards_are_drawn_alike_in_any_range(monkeypatch):
    totals = [700, 12, 0, 31]
    whole = list(mixing.shard_counts(totals, 0, 10**9, shard=16))
    shards = mixing.shards_of(totals, 16)
    assert shards == -(-743 // 16) and {d[0] for d in whole} == set(range(shards))
    assert [d for k in range(0, shards, 7) for d in mixing.shard_counts(totals, k, k + 7, shard=16)] == whole
    for k, total in enumerate(totals):
        mine = [d for d in whole if d[1] == k]
        assert sum(d[3] for d in mine) == total
        assert all(a[2] + a[3] == b[2] for a, b in zip(mine, mine[1:]))
    assert all(sum(d[3] for d in whole if d[0] == s) == 16 for s in range(shards - 1))
    assert len({d[3] for d in whole if d[1] == 1}) > 1 or len([d for d in whole if d[1] == 1]) < shards
    monkeypatch.setattr(mixing, "STRATUM", 100)
    parts = list(mixing.shard_counts(totals, 0, 10**9, shard=16))
    assert [sum(d[3] for d in parts if d[1] == k) for k in range(4)] == totals


def test_blocks_are_equal_and_hold_every_token_once(spark):
    dice = random.Random(8)
    rows, start = [], 0
    for k in range(60):
        size = dice.randrange(1, 90)
        rows.append(("s", k, start, size))
        start += size
    records = spark.createDataFrame(rows, "source_name string, doc_id bigint, start bigint, tokens bigint")
    for block in (7, 100, 10**6):
        sizes = spark.createDataFrame([("s", start, mixing.blocks_of(start, block))], "source_name string, total bigint, blocks bigint")
        pieces = mixing.in_blocks(records, sizes)
        assert sorted((r.doc_id, r.n) for r in pieces.groupBy("doc_id").agg(F.sum("part").alias("n")).collect()) == [(k, n) for _, k, _, n in rows]
        held = [r.n for r in pieces.groupBy("block").agg(F.sum("part").alias("n")).collect()]
        assert len(held) == mixing.blocks_of(start, block) and max(held) - min(held) <= 1
    # no overflow far out in a stream
    far = spark.createDataFrame([("s", 1, 9 * 10**14, 600)], "source_name string, doc_id bigint, start bigint, tokens bigint")
    sizes = spark.createDataFrame([("s", 10**15, 10**15 // 512)], "source_name string, total bigint, blocks bigint")
    assert mixing.in_blocks(far, sizes).agg(F.sum("part")).first()[0] == 600


def test_permutations_use_every_block_once(spark):
    for size in (1, 2, 7, 100, 1000):
        df = spark.range(size * 2).select(F.col("id"), F.lit(size).cast("long").alias("n"))
        got = df.select(F.floor(F.col("id") / F.col("n")).alias("turn"), mixing._permuted(F.col("id") % F.col("n"), F.col("n"), F.floor(F.col("id") / F.col("n"))).alias("p"))
        assert got.groupBy("turn").agg(F.countDistinct("p").alias("d"), F.min("p").alias("a"), F.max("p").alias("b")).where(f"d = {size} and a = 0 and b = {size - 1}").count() == 2


def test_streams_and_uses(spark):
    dice = random.Random(6)
    rows = [("hot", k, dice.randrange(1, 60)) for k in range(500)] + [("small", 1000 + k, 5) for k in range(20)] + [("small", 1000, 5)]
    df = spark.createDataFrame(rows, "source_name string, doc_id bigint, tokens bigint")
    placed = mixing.stream(df, range_rows=20).orderBy("source_name", "start").collect()
    at = {}
    for r in placed:
        assert r.start == at.get(r.source_name, 0)
        at[r.source_name] = r.start + r.tokens
    blocks = {"hot": 40, "small": 3}
    uses = mixing.block_uses(spark, blocks, {"hot": 70, "small": 9}, shard=8).groupBy("source_name", "block").count().collect()
    assert sum(r["count"] for r in uses if r.source_name == "hot") == 70
    assert {r["count"] for r in uses if r.source_name == "small"} == {3} and {r["count"] for r in uses if r.source_name == "hot"} == {1, 2}


def test_source_names(spark):
    df = spark.createDataFrame([(" Harbor-Press ",), ("harbor__press",), (None,)], "s string")
    assert [r[0] for r in df.select(mixing.source_key(F.col("s"))).collect()] == ["harbor_press", "harbor_press", None]

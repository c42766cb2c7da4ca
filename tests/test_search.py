import math
import random

from pyspark.sql import functions as F

from lectern.functions.terms import search_terms, set_cosine, title_similarity, token_set
from lectern.operators import search


def test_terms_of_mixed_scripts(spark):
    df = spark.createDataFrame([("Don't re-read 记忆法 中 End_1",)], "t string")
    assert sorted(df.select(search_terms(F.col("t"))).first()[0]) == sorted(["don't", "re-read", "记忆法", "中", "end_1", "记忆", "忆法", "中"])


def test_lexical_ranks_the_passage_that_answers(spark):
    items = spark.createDataFrame([(1, "Attention starts with a question."), (2, "Memory preserves the path to evidence."), (3, None)], "id bigint, text string")
    asked = spark.createDataFrame([(9, "How does memory preserve evidence?")], "query_id bigint, text string")
    rows = search.lexical_search(items.where("text is not null"), asked).collect()
    assert rows[0].id == 2


def test_lexical_score_counts_repeated_query_terms(spark):
    items = spark.createDataFrame([(1, "a a b"), (2, "b c")], "id bigint, text string")
    asked = spark.createDataFrame([(0, "a a b")], "query_id bigint, text string")
    got = {r.id: r.score for r in search.lexical_search(items, asked).collect()}
    idf = lambda df: math.log(3 / (df + 1)) + 1
    assert got[1] == round(2 * (1 + math.log(2)) * idf(1) + idf(2), 6) and got[2] == round(idf(2), 6)


def test_vector_search_against_brute_force(spark):
    dice = random.Random(1)
    rows = [(k, [dice.gauss(0, 1) for _ in range(8)]) for k in range(60)] + [(99, [0.0] * 8), (98, [1.0]), (97, None)]
    items = spark.createDataFrame(rows, "id bigint, vector array<float>")
    asked = items.where("id < 5").withColumnRenamed("id", "query_id")
    got = {}
    for r in search.vector_search(items, asked, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    for k in range(5):
        scores = sorted(((-round(sum(a * b for a, b in zip(rows[k][1], v)) / norm(rows[k][1]) / norm(v), 5), i) for i, v in rows if v and len(v) == 8))
        assert got[k] == [i for _, i in scores[:4]]


def test_fusion_and_rerank(spark):
    lexical = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, key string, rank int")
    vector = spark.createDataFrame([(1, "c", 1), (1, "a", 2)], "query_id int, key string, rank int")
    rows = search.reciprocal_rank_fusion({"lexical": (lexical, 1.0), "vector": (vector, 1.0), "off": (vector, 0.0)}, k=2).orderBy("rank").collect()
    assert [r.key for r in rows] == ["a", "c"] and rows[0].score == round(1 / 61 + 1 / 62, 6)
    hits = spark.createDataFrame([(1, 1, 1.0, 1, "memory and paths", "paths of memory"), (1, 2, 1.0, 2, "memory and paths", "on Memory  and paths")], "query_id int, id int, score double, rank int, query_text string, text string")
    assert [r.id for r in search.rerank(hits).orderBy("new_rank").collect()] == [2, 1]


def test_set_scores(spark):
    df = spark.createDataFrame([("Abc abc 记忆", "abc 忆 x"), ("", "a"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(F.round(set_cosine(token_set(F.col("a")), token_set(F.col("b"))), 6)).collect()]
    assert got == [round(2 / 3, 6), 0.0, 0.0]
    pairs = spark.createDataFrame([("abc", "abc"), ("abc", "abcd"), ("night", "nacht"), ("", "x"), ("a", "b")], "a string, b string")
    got = [r[0] for r in pairs.select(F.round(title_similarity(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [1.0, round(0.75 * 0.35 + 0.65, 6), round(1 / 7, 6), 0.0, 0.0]


def test_searches_in_blocks_of_queries_give_the_same(spark, monkeypatch):
    dice = random.Random(2)
    words = "map coast salt clerk ledger seed keeper harbour wind mark".split()
    rows = [(k, " ".join(dice.choice(words) for _ in range(dice.randrange(1, 30))), dice.choice([None, 1, 2])) for k in range(80)]
    items = spark.createDataFrame([*rows, (900, "", 1), (901, None, 1)], "id bigint, text string, chapter int").where("text is not null")
    asked = items.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    for find in (search.lexical_search, search.set_search):
        for same in (None, "chapter"):
            monkeypatch.setattr(search, "QUERY_BLOCK", 4096)
            monkeypatch.setattr(search, "SCORES", 4_000_000)
            whole = sorted(map(tuple, find(items, asked, k=5, same=same, tie="chapter").collect()))
            monkeypatch.setattr(search, "QUERY_BLOCK", 3)
            monkeypatch.setattr(search, "SCORES", 40)
            assert sorted(map(tuple, find(items, asked, k=5, same=same, tie="chapter").collect())) == whole
    chapter = {k: c for k, _, c in rows}
    got = search.lexical_search(items, asked, k=80, same="chapter").collect()
    assert all(chapter[r.query_id] in (None, chapter.get(r.id)) for r in got)
    assert any(chapter[r.query_id] is None and chapter.get(r.id) for r in got)
    assert search.lexical_search(items, asked.limit(0)).count() == 0 and search.lexical_search(items.limit(0), asked).count() == 0


def test_vector_index_and_tag_sets(spark):
    dice = random.Random(4)
    centres = [[dice.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, [x + dice.gauss(0, 0.3) for x in centres[k % 6]], k % 3) for k in range(600)]
    items = spark.createDataFrame(rows, "id bigint, vector array<float>, kind int")
    asked = items.where("id < 30").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in search.vector_search(items, asked, k=10).collect()}
    index = search.CellIndex(items, sample=400)
    near = {(r.query_id, r.id) for r in index.search(index.assign(items), asked, k=10).collect()}
    assert len(near & exact) >= 0.9 * len(exact) and index.assign(items).where("cell is null").count() == 0 and index.probes < len(index.centres)
    kinds = asked.withColumn("kinds", F.when(F.col("query_id") > 2, F.array(F.lit(0), F.lit(2))))
    got = search.vector_search(items, kinds, k=40, tag="kind", tags="kinds").collect()
    assert all(r.query_id <= 2 or r.id % 3 != 1 for r in got) and any(r.id % 3 == 1 for r in got)
    empty = search.CellIndex(items.limit(0))
    assert empty.search(empty.assign(items.limit(0)), asked.limit(0)).count() == 0

from pyspark.sql import functions as F

from lectern.operators import structure as s


def test_kinds_labels_and_joins(spark):
    df = spark.createDataFrame([("Chapter 3", "O7"), ("第三章 海岸", "[12]"), ("Part IV", "x"), ("Index", "12345"), ("Preface", " 9 "), ("The coast", "lS")], "t string, l string")
    got = df.select(s.heading_kind(F.col("t")), s.page_label(F.col("l"))).collect()
    assert [r[0] for r in got] == ["chapter", "chapter", "part", "back_matter", "front_matter", "section"]
    assert [r[1] for r in got] == [7, 12, None, None, 9, 15]
    pairs = spark.createDataFrame([("the har-", "bour"), ("海岸", "记忆"), ("a", "b")], "a string, b string")
    assert [r[0] for r in pairs.select(s.joined(F.col("a"), F.col("b"))).collect()] == ["the harbour", "海岸记忆", "a b"]


def test_damaged_page_labels(spark):
    df = spark.createDataFrame([("001",), ("l2 3",), ("i(>5",), ("ISBN 978-7-0000",), ("（12）",), ("1(2",), ("",), (None,)], "l string")
    assert [r[0] for r in df.select(s.page_label(F.col("l"))).collect()] == [1, 123, 105, None, 12, 12, None, None]


def test_edges(spark):
    rows = [("d", p, k, t) for p in range(1, 6) for k, t in enumerate([f"Book {p}", f"text {p} body", "end" if p % 2 else f"other {'x' * p}"])]
    lines = spark.createDataFrame(rows, "document string, page int, line int, text string")
    assert {(r.edge, r.signature, r.pages) for r in s.edge_lines(lines).collect()} == {("top", "book #", 5), ("bottom", "end", 3)}
    assert s.without_edges(lines).count() == 7


def test_columns_contents_and_offsets(spark):
    lines = spark.createDataFrame([("d", 1, 0.0, 40.0, 100.0), ("d", 1, 0.0, 42.0, 100.0), ("d", 1, 60.0, 100.0, 100.0), ("d", 2, 0.0, 100.0, 100.0)], "document string, page int, x0 double, x1 double, width double")
    assert [(r.page, round(r.split, 1)) for r in s.columns_split(lines).collect()] == [(1, 50.5)]
    text = ["One ..... 3", "Two     9", "Back .... 4", "Three\t12", "no entry"]
    lines = spark.createDataFrame([("d", 1, k, t) for k, t in enumerate(text)], "document string, page int, line int, text string")
    assert [(r.title, r.label) for r in s.printed_contents(lines).orderBy("line").collect()] == [("One", 3), ("Two", 9), ("Three", 12)]
    entries = spark.createDataFrame([("d", 3, 13), ("d", 9, 19), ("d", 12, 23), ("d", 20, 99), ("e", 1, 2)], "document string, label int, page int")
    assert [(r.document, r.offset, r.share) for r in s.label_offsets(entries).collect()] == [("d", 10, 0.75)]


def test_alignment_and_outline(spark):
    rows = [("d", 1, 5, 0.9), ("d", 2, 3, 1.0), ("d", 2, 7, 0.8), ("d", 3, 6, 0.2), ("d", 3, 8, 0.9)]
    got = s.align(spark.createDataFrame(rows, "document string, entry int, page int, score double")).orderBy("entry").collect()
    assert [(r.entry, r.page) for r in got] == [(1, 5), (2, 7), (3, 8)]
    entries = spark.createDataFrame([("d", k, v) for k, v in enumerate([1, 2, 3, 2, 1, 3])], "document string, ordinal int, level int")
    assert [r.parent for r in s.outline_parents(entries).orderBy("ordinal").collect()] == [None, 0, 1, 0, None, 4]
    assert s.page_blocks(5, 2) == [(1, 2), (3, 4), (5, 5)]

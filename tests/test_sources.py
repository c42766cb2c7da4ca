import io
import zipfile

import pytest

from lectern.operators.passages import chunk
from lectern.sources import formats, readers, sinks
from lectern.streaming import ledgers

PAGE = b"<html><head><title>T</title><script>var a='</p>';</script></head><body><p>Intro</p><h1 id='one'>One</h1><p>Text &amp; more</p><h3>Sub</h3><nav>no</nav><h2>Two</h2><p>End</p></body></html>"


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.xhtml", "<p>Cover</p>")
        z.writestr("O/b.xhtml", PAGE)
    return out.getvalue()


def docx():
    out = io.BytesIO()
    w = "xmlns:w='http://x'"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    return out.getvalue()


def test_formats():
    assert formats.detect("/x/A.XHTML") == "html" and formats.detect("a.bin", "txt") == "txt"
    with pytest.raises(formats.SourceError):
        formats.detect("a.bin")
    assert formats.decode("é中".encode()) == "é中" and formats.decode("中文内容".encode("gb18030")) == "中文内容" and formats.decode("café".encode("cp1252")) == "café"
    assert formats.html_text(PAGE.decode()) == "Intro\n\nOne\n\nText & more\n\nSub\n\nTwo\n\nEnd"
    units = formats.parse_html(PAGE)
    assert [(u.title, u.text) for u in units] == [("T", "Intro"), ("One", "Text & more\n\nSub"), ("Two", "End")] and units[1].locator["fragment"] == "one"
    units = formats.parse_text(b"lead\n\nChapter 1\n\nfoo\nbar\n\nTwo\n---\nbaz")
    assert [(u.title, u.text) for u in units] == [("Front Matter", "lead"), ("Chapter 1", "foo\nbar"), ("Two", "baz")]
    assert [u.title for u in formats.parse_epub(epub())] == ["T", "One", "Two"]
    assert [(u.title, u.text) for u in formats.parse_docx(docx())] == [("H", "Body\n\na | b")]


def test_headings_of_all_kinds():
    cases = {"1.2 The coast": (2, "1.2 The coast"), "3.1.4 Salt and wind": (3, "3.1.4 Salt and wind"), "一、海岸": (2, "一、海岸"), "第三章 海岸": (1, "第三章 海岸"), "## Next": (2, "Next")}
    for line, want in cases.items():
        assert formats.heading(line) == want, line
    for line in ("1.2 is less than 1.3, as the clerk says.", "3 apples", "一、海岸是旧的。", "1.5", ""):
        assert formats.heading(line) is None, line
    assert formats.heading("Title", "=====") == (1, "Title")


def test_nested_headings():
    got = formats.nested([(1, "A"), (3, "a"), (2, "b"), (3, "c"), (1, "B"), (2, "d")])
    assert got == [(None, ["A"]), (1, ["A", "a"]), (1, ["A", "b"]), (3, ["A", "b", "c"]), (None, ["B"]), (5, ["B", "d"])]
    assert formats.nested([]) == []


def test_contents_of_an_epub_name_its_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package><manifest><item id="n" href="toc.ncx"/><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/toc.ncx", '<ncx><navMap><navPoint><navLabel><text> The  Coast </text></navLabel><content src="b.xhtml#x"/></navPoint></navMap></ncx>')
        z.writestr("O/a.xhtml", "<p>Cover</p>")
        z.writestr("O/b.xhtml", "<p>No heading here</p>")
    assert [u.title for u in formats.parse_epub(out.getvalue())] == ["The Coast"]
    assert len(formats.parse_epub(out.getvalue(), keep_front_matter=True)) == 2


def test_outlines_and_rejected_files(spark, tmp_path):
    (tmp_path / "o").mkdir()
    page = "<html><head><title>Book</title></head><body><nav><a href='x'>no</a></nav><h1 id='start'>Opening</h1><p>one</p><h3>Deeper</h3><p>two</p><h2>Second chapter</h2><p>three</p></body></html>"
    (tmp_path / "o/a.html").write_text(page)
    (tmp_path / "o/empty.txt").write_text("")
    (tmp_path / "o/long.txt").write_text("x" * 900)
    heads = readers.read_outline(spark, f"{tmp_path}/o", 800).orderBy("ordinal").collect()
    assert [(r.title, r.parent, r.unit) for r in heads] == [("Opening", None, 1), ("Deeper", 1, 1), ("Second chapter", 1, 2)]
    assert heads[2].breadcrumb == ["Opening", "Second chapter"]
    rows = readers.read_units(spark, f"{tmp_path}/o", 800).collect()
    assert {r.source_path.rsplit("/", 1)[1]: r.error for r in rows if r.error} == {"long.txt": "more bytes than 800"}
    assert [r.breadcrumb for r in rows if not r.error] == [["Opening"], ["Opening", "Second chapter"]]
    assert formats.parse_html(page.encode())[0].locator["fragment"] == "start"


def test_read_units_and_chapters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_bytes(PAGE)
    (tmp_path / "in/b.epub").write_bytes(epub())
    (tmp_path / "in/c.epub").write_bytes(b"broken")
    (tmp_path / "in/empty.txt").write_bytes(b"")
    (tmp_path / "in/d.xyz").write_bytes(b"?")
    rows = readers.read_units(spark, f"{tmp_path}/in").collect()
    assert sum(r.error is None for r in rows) == 6 and sum(r.error is not None for r in rows) == 2
    assert len({r.unit_id for r in rows if r.unit_id}) == 6
    (tmp_path / "ch").mkdir()
    (tmp_path / "ch/07-x.md").write_text("# T\n\n> Chapter: 3\n\nbody")
    (tmp_path / "ch/08-y.md").write_text("# T\n\nbody")
    assert sorted(r.chapter for r in readers.read_chapters(spark, f"{tmp_path}/ch").collect()) == [3, 8]
    (tmp_path / "u.jsonl").write_text('{"run_id": "r", "total_tokens": 3}\nnot json\n')
    usage = readers.read_usage(spark, f"{tmp_path}/u.jsonl").collect()
    assert [r.total_tokens for r in usage] == [3, None] and usage[1].bad_line == "not json"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "id string, body string")
    path = f"{tmp_path}/t"
    assert sinks.append_once(rows, path, "id", "body") == 2 and sinks.append_once(rows, path, "id", "body") == 0
    with pytest.raises(sinks.CollisionError):
        sinks.append_once(spark.createDataFrame([("a", "9")], "id string, body string"), path, "id", "body")
    sinks.publish({"t": rows}, f"{tmp_path}/p", "v1", rows.limit(0))
    sinks.publish({"t": rows.limit(1)}, f"{tmp_path}/p", "v2", rows.limit(0))
    assert sinks.published(spark, f"{tmp_path}/p", "t").count() == 1
    with pytest.raises(ValueError):
        sinks.publish({"t": rows}, f"{tmp_path}/p", "v3", rows)
    (tmp_path / "p" / "pointers" / "00000003").mkdir()  # a pointer that is still being written
    assert sinks.current_version(spark, f"{tmp_path}/p") == "v2" and sinks.current_version(spark, f"{tmp_path}/none") is None
    sinks.replace_partitions(rows, f"{tmp_path}/r", "id")
    sinks.replace_partitions(spark.createDataFrame([("a", "7")], "id string, body string").select("body", "id"), f"{tmp_path}/r", "id")
    assert sorted(r.body for r in spark.read.parquet(f"{tmp_path}/r").collect()) == ["2", "7"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("ok", 5), ("ok", 7), ("bad", None)], "status string, total_tokens int")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    ledgers.usage_stream(ledgers.stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert {r.status: (r.calls, r.tokens) for r in ledgers.usage_totals(spark, f"{tmp_path}/out").collect()} == {"ok": (2, 12), "bad": (1, None)}
    def feed(*rows):
        spark.createDataFrame(rows, "source_path string, chapter int, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ch")
        ledgers.incremental_index(ledgers.stream(spark, f"{tmp_path}/ch"), f"{tmp_path}/ix", f"{tmp_path}/cp1", chunk)
        return sorted((r.source_path, r.text) for r in ledgers.indexed(spark, f"{tmp_path}/ix").collect())

    assert feed(("a", 1, "text one"), ("b", 2, "text two")) == [("a", "text one"), ("b", "text two")]
    assert feed(("a", 1, "text three")) == [("a", "text three"), ("b", "text two")]
    assert feed(("a", 1, "text one"), ("b", 2, "text two")) == [("a", "text one"), ("b", "text two")]
    assert feed(("b", 2, None)) == [("a", "text one")]
    # another stream of the same files ends where this one did
    ledgers.incremental_index(ledgers.stream(spark, f"{tmp_path}/ch", 1), f"{tmp_path}/ix", f"{tmp_path}/cp2", chunk)
    assert ledgers.indexed(spark, f"{tmp_path}/ix").where("source_path = 'a'").count() == 1


def test_leases(spark, tmp_path):
    events = [("j", "w1", "claim", 0), ("j", "w2", "claim", 100), ("j", "w1", "renew", 200), ("j", "w2", "claim", 600), ("j", "w1", "finish", 610), ("j", "w2", "finish", 620), ("j", "w3", "claim", 9000)]
    df = spark.createDataFrame(events, "job string, owner string, action string, s int").selectExpr("job", "owner", "action", "timestamp_seconds(s) at")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    query = ledgers.leases(ledgers.stream(spark, f"{tmp_path}/e")).writeStream.format("memory").queryName("lease").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.accepted for r in spark.table("lease").collect()] == [True, False, True, True, False, True, False]

"""Parsing and rendering of every format."""

import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.sources import archives, formats, render, task_files

SRT = "1\n00:00:01,000 --> 00:00:02,000\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n\n3\n00:00:05,000 --> 00:00:06,000\n<i>Bye</i>\n"
ASS = "[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,Hi, {\\i1}you\nComment: 0,a\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,\n"
LRC = "[ti:Song]\n[00:01.00][00:05.00] First line\nplain line\n[offset:+5]\n[00:09]\n"
HTML = '<html><head><title> My page </title><style>b{}</style><meta name="x"></head><body><p title="tip">One <b>two</b>\n<img alt="pic" src="a"> three &amp; four<script>no</script><p>five</body></html>'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def texts(kind, raw):
    return [u[2] for u in formats.PARSERS[kind](raw)]


def upper(kind, raw):
    units = formats.PARSERS[kind](raw)
    return render.rendered(kind, raw, [(u[1], u[2].upper()) for u in units])


def test_dispatch():
    assert [formats.format_of(p) for p in ("a/B.MD", "x.htm", "x.tar.json", "noext", "a.b/c")] == ["markdown", "html", "json", None, None]


def test_markdown_blocks():
    raw = b"para one\nstill\n\n# head\n\n```\ncode\n\nmore\n```\ntail *x*"
    units = formats.markdown(raw)
    assert "".join(u[2] for u in units).encode() == raw and [u[3] for u in units] == [True, False, False, False]
    assert formats.markdown(b"") == [("block", "0", "", True)]


def test_json():
    raw = json.dumps({"b": "x", "a": [1, "y", {"k/~": ""}], "n": None}).encode()
    assert [(u[1], u[2]) for u in formats.json_strings(raw)] == [("/b", "x"), ("/a/1", "y"), ("/a/2/k~1~0", "")]
    assert json.loads(upper("json", raw)) == {"b": "X", "a": [1, "Y", {"k/~": ""}], "n": None} and list(json.loads(upper("json", raw))) == ["b", "a", "n"]


def test_html():
    assert texts("html", HTML.encode()) == ["My page", "One", "two", "three & four", "five", "tip", "pic"]
    out = upper("html", HTML.encode()).decode()
    assert "<title> MY PAGE </title>" in out and 'title="TIP"' in out and 'alt="PIC"' in out and "<script>no</script>" in out and " THREE &amp; FOUR<" in out
    assert texts("html", b"<p>a<b>c</p>d<!-- x -->e</b>") == ["a", "c", "d", "e"]


def test_subtitles():
    assert texts("srt", SRT.encode()) == ["Hello\nthere", "<i>Bye</i>"]
    assert [u[1].split(";")[0] for u in formats.srt(SRT.encode())] == ["entry:0", "entry:2"]
    assert upper("srt", SRT.encode()).decode() == SRT.replace("Hello\nthere", "HELLO\nTHERE").replace("<i>Bye</i>", "<I>BYE</I>")
    crlf = SRT.replace("\n", "\r\n")
    assert texts("srt", crlf.encode()) == ["Hello\r\nthere", "<i>Bye</i>"]
    with pytest.raises(ValueError):
        formats.srt(b"1\nno time\ntext\n")
    assert texts("ass", ASS.encode()) == ["Hi, {\\i1}you"] and upper("ass", ASS.encode()).decode() == ASS.replace("Hi, {\\i1}you", "HI, {\\I1}YOU")
    assert texts("lrc", LRC.encode()) == ["First line", "plain line"] and b"[00:01.00][00:05.00] FIRST LINE\nPLAIN LINE\n" in upper("lrc", LRC.encode())
    with pytest.raises(ValueError, match="overlapping"):
        render.patched("abcdef", [("range:0:3", "x"), ("range:2:4", "y")])


def test_office():
    body = '<w:document xmlns:w="w"><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t xml:space="preserve"> two</w:t></w:r></w:p><w:p/><w:tbl><w:p><w:t>cell</w:t></w:p></w:tbl><w:p><w:t>A &amp; B</w:t></w:p></w:document>'
    raw = archive(word__document_dot_xml=body, word__styles_dot_xml="<s/>")
    assert [(u[2], u[3]) for u in formats.docx(raw)] == [("One two", False), ("cell", False), ("A & B", True)]
    assert [u[1].split(";")[0] for u in formats.docx(raw)] == ["block:0", "block:2", "block:3"]
    out = zipfile.ZipFile(io.BytesIO(upper("docx", raw)))
    assert out.read("word/styles.xml") == b"<s/>" and b"<w:t>ONE TWO</w:t></w:r><w:r><w:t xml:space=\"preserve\"></w:t>" in out.read("word/document.xml") and b"A &amp; B" in out.read("word/document.xml")
    sheet = archive(xl__sharedStrings_dot_xml="<sst><si><t>x</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
    assert [(u[2], u[3]) for u in formats.xlsx(sheet)] == [("x", True), ("ab", False)] and formats.xlsx(archive(other="1")) == []


def test_epub():
    package = '<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/></manifest><spine><itemref idref="b"/></spine></package>'
    raw = archive(**{"META-INF__container_dot_xml": '<c><rootfile full-path="OPS/p.opf"/></c>', "OPS__p_dot_opf": package, "OPS__a_dot_xhtml": "<p>left over</p>", "OPS__t__b_dot_xhtml": "<p>first</p>", "OPS__c_dot_css": "x"})
    assert [(u[1], u[2]) for u in formats.epub(raw)] == [("OPS/t/b.xhtml;node:0", "first"), ("OPS/a.xhtml;node:0", "left over")]
    assert zipfile.ZipFile(io.BytesIO(upper("epub", raw))).read("OPS/t/b.xhtml") == b"<p>FIRST</p>"


def test_folder_and_faults(spark, tmp_path):
    for name, raw in (("a.srt", SRT.encode()), ("b.json", b"{bad"), ("c.bin", b"x"), ("d.txt", "tä".encode())):
        (tmp_path / name).write_bytes(raw)
    rows = formats.read_units(spark, f"file://{tmp_path}").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rpartition("/")[2], []).append(r)
    assert len(by["a.srt"]) == 2 and by["b.json"][0].error.startswith("JSONDecodeError") and "unsupported" in by["c.bin"][0].error and by["d.txt"][0].text == "tä"


def test_task_files(spark, tmp_path):
    path = tmp_path / "t.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE metadata (task_id, schema_version, status, source_language, target_language)")
        c.execute("CREATE TABLE chunks (id, sequence, source_text, translated_text, status, updated_at)")
        c.execute("INSERT INTO chunks VALUES ('x', 0, 'a', '', 'success', '1')")
    frame = spark.createDataFrame([("good", bytearray(path.read_bytes())), ("bad", bytearray(b"no database"))], "path string, content binary")
    rows = {r.path: r for r in task_files.table(frame, "chunks").collect()}
    assert json.loads(rows["good"].row)["source_text"] == "a" and rows["bad"].error == "damaged"


def test_documents_are_rendered_as_a_table(spark):
    files = [("a.json", b'{"x": "one", "y": ["two"]}'), ("b.srt", b"1\n00:00:01,000 --> 00:00:02,000\nHi\n"), ("c.pdf", b"?"), ("d.txt", b"plain")]
    frame = spark.createDataFrame(files, "path string, content binary")
    units = formats.parsed(frame).withColumn("text", F.upper("text"))
    got = {r.path: (bytes(r.content or b""), r.error) for r in render.documents(frame, units).collect()}
    assert json.loads(got["a.json"][0]) == {"x": "ONE", "y": ["TWO"]} and got["b.srt"][0].endswith(b"\nHI\n") and got["d.txt"][0] == b"PLAIN"
    broken = spark.createDataFrame([("b.srt", 0, "range:5:2", "x")], "path string, ordinal long, address string, text string")
    assert {r.path: r.error is not None for r in render.documents(frame, broken).collect()}["b.srt"]


def test_archives_and_readers(spark, tmp_path):
    raw = archive(**{"a/x.md": "first", "b/full.md": "whole ![](i.png)", "b/i.png": "p", "../evil.png": "e", "c.txt": "t"})
    frame = spark.createDataFrame([("z.zip", raw), ("bad.zip", b"?")], "path string, content binary")
    entries = archives.archive_entries(frame).cache()
    assert [(r.path, r.markdown) for r in archives.main_document(entries).collect()] == [("z.zip", "whole ![](i.png)")]
    assert [(r.name, r.media_type) for r in archives.assets(entries).collect()] == [("b/i.png", "image/png")]
    assert entries.filter("error is not null").count() == 1

    def fails(raw):
        raise ValueError("no")

    readers = [("one", fails), ("two", lambda raw: " "), ("three", lambda raw: raw.decode())]
    got = {r.path: r for r in archives.converted(spark.createDataFrame([("a.pdf", b"text"), ("b.pdf", b"\xff")], "path string, content binary"), readers).collect()}
    assert (got["a.pdf"].engine, got["a.pdf"].markdown, len(got["a.pdf"].diagnostics)) == ("three", "text", 2) and got["b.pdf"].markdown is None
    rows = archives.glossary_rows(spark.createDataFrame([("g.csv", b"dst,src\nx,a\n"), ("g.json", b'{"a":"b"}'), ("g.csv2", b""), ("h.csv", b"a\n")], "path string, content binary")).collect()
    assert sorted((r.path, r.src) for r in rows if r.error is None) == [("g.csv", "a"), ("g.json", "a")] and sum(r.error is not None for r in rows) == 2
    target = f"file://{tmp_path}/out"
    archives.published(spark.range(3), target)
    assert spark.read.parquet(target).count() == 3 and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError, match="exists"):
        archives.published(spark.range(3), target)
    with pytest.raises(Exception, match="boom"):
        archives.published(spark.range(3).select(F.raise_error(F.lit("boom")).alias("x")), f"{target}2")
    assert len(list(tmp_path.iterdir())) == 1

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from recall_engine.sources import extract as X, files, settings


def archive(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


DOCX = archive(**{"word/document.xml": '<w:document><w:p>Bonjour</w:p><w:p x="1">le &amp; monde</w:p></w:document>', "word/footnotes.xml": "<w:p>note</w:p>"})
XLSX = archive(**{
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Feuil1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>poste</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c/><c><v>12</v></c></row><row><c/></row></sheetData></worksheet>',
})


def test_formats():
    assert X.text_of(DOCX, "docx").split() == ["Bonjour", "le", "&", "monde", "note"]
    assert X.text_of(XLSX, "xlsx") == "# Feuil1\nposte 12"
    assert X.text_of("<p>a &eacute;</p><script>x</script>".encode(), "html") == "a é"
    assert X.text_of(b'{"cells": [{"source": ["a", "b"]}, {"source": "c"}]}', "ipynb") == "ab\n\nc"
    assert X.text_of(b"not json", "ipynb") == "not json"
    assert X.text_of(b"{\\rtf1 caf\\'e9 noir}", "rtf") == "café noir"
    assert X.text_of(b"Subject: Devis\nFrom: a@b.test\nContent-Type: text/plain\n\nbonjour", "eml") == "Subject: Devis\nFrom: a@b.test\n\nbonjour"
    assert X.text_of(archive(**{"b.xhtml": "<p>two</p>", "a.xhtml": "<p>one</p>"}), "epub").split() == ["one", "two"]
    assert X.text_of(archive(**{"content.xml": "<text:p>un</text:p><text:h>deux</text:h>"}), "odt").split() == ["un", "deux"]
    assert X.text_of(archive(**{f"ppt/slides/slide{i}.xml": f"<a:p>{i}</a:p>" for i in (10, 2)}), "pptx").split() == ["2", "10"]
    assert X.text_of(b"\x00\x01binary", "txt") == "" and X.text_of(b"zip", "zip") == ""
    assert X.text_of("é".encode("utf-16"), "txt") == "é" and X.text_of(b"\xe9", "txt") == "é"
    assert len(X.text_of(b"x" * 1000, "txt", limit=10)) == 10


def test_failures_belong_to_their_row(spark):
    rows = spark.createDataFrame([("/a", "docx", 3, b"bad", False), ("/b", "txt", 2, b"ok", False), ("/c", "txt", 0, b"", False), ("/d", "zip", 1, b"z", False), ("/e", "txt", 10**9, b"", False), ("/f", "txt", 1, None, True), ("/g", "txt", 1, None, None)], "path string, ext string, size long, content binary, dataless boolean")
    got = {r.path: r for r in X.extract(rows).collect()}
    assert {p: r.status for p, r in got.items()} == {"/a": "error", "/b": "ok", "/c": "empty", "/d": "skipped", "/e": "too_big", "/f": "dataless", "/g": "empty"}
    assert got["/a"].error and got["/b"].text == "ok"


def test_time_limit(spark):
    def slow(data, limit):
        while True:
            pass

    assert X.outcome(b"", "slow", 10, 1, {"slow": slow})[1] == "timeout"


def test_a_process_that_hangs_or_dies_is_replaced():
    def deaf(data, limit):  # as native code that no signal interrupts
        import signal
        import time

        signal.pthread_sigmask(signal.SIG_BLOCK, range(1, 32))
        time.sleep(60)

    readers = {"deaf": deaf, "dead": lambda d, n: os._exit(9), "good": lambda d, n: "text"}
    with X.Isolated(10, 0.5, readers) as read:
        assert [read(b"", e)[1] for e in ("good", "deaf", "good", "dead", "good", "good")] == ["ok", "timeout", "ok", "error", "ok", "ok"]


def test_mail_parts():
    page = b"Subject: S\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\nContent-Disposition: attachment\n\nno\n--b\nContent-Type: text/html\n\n<p>caf&eacute;</p>\n--b--\n"
    assert X.text_of(page, "eml") == "Subject: S\n\n café"
    assert X.text_of(b"99\n" + page, "emlx") == "Subject: S\n\n café"
    assert X.text_of(b"Subject: S\nContent-Type: application/pdf\n\nx", "eml") == "Subject: S"


def test_markup():
    assert X.clean(X.from_html("a<style>x</style>b <svg><style>y</style><path/></svg>c&nbsp;d <!-- e --> f < g")).replace("\xa0", " ") == "a b c d f < g"
    assert X.clean("a\n \n\n\tb  c\r\n") == "a\n\n b c"
    assert X.decode("é".encode("utf-16")) == "é" and X.decode(b"\xff\xfe\x00") == "ÿþ\x00"


def test_scan(spark, tmp_path):
    for name in ("a.md", "sub/b.TXT", "sub/.hidden", "node_modules/x.js", "note.pages/index.xml", "env1/pyvenv.cfg", "env1/lib/y.py", "é.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text")
    rows = {r.name: r for r in files.scan(spark, [str(tmp_path), str(tmp_path / "sub")], content=True).collect()}
    assert set(rows) == {"a.md", "b.TXT", "note.pages", "é.txt"}
    assert (rows["b.TXT"].ext, rows["b.TXT"].rel_parent, rows["b.TXT"].kind, rows["note.pages"].size) == ("txt", "sub", "text", 0)
    assert rows["a.md"].root == os.path.basename(tmp_path) and bytes(rows["a.md"].content) == b"text"


@pytest.mark.parametrize("budget", [1, 3, 10_000])
def test_walk_leaves_folders_out_before_it_looks(spark, tmp_path, monkeypatch, budget):
    kept = ("_notes.md", "_private/a.txt", "a/b/c/d/e.txt", "note.key/index.apxl", "x.pdf")
    left = (".git/config", "node_modules/m/i.js", "env9/pyvenv.cfg", "env9/lib/y.py", "Foo.framework/f.txt", "b.pyc", "~$x.docx", "sub/.hidden")
    for name in (*kept, *left):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("12345")
    (tmp_path / "link.txt").symlink_to(tmp_path / "x.pdf")
    (tmp_path / "loop").symlink_to(tmp_path)
    found = {r.raw.removeprefix(f"{tmp_path}/"): r for r in files.walk(spark, [str(tmp_path)], budget=budget).collect()}
    assert set(found) == {"_notes.md", "_private/a.txt", "a/b/c/d/e.txt", "note.key", "x.pdf"}
    assert found["note.key"].size == 0 and found["x.pdf"].size == 5
    rows = {r.name: r.content for r in files.scan(spark, [str(tmp_path)], content=True).collect()}
    assert bytes(rows["_notes.md"]) == b"12345" and rows["note.key"] is None
    assert files.walk(spark, [str(tmp_path / "nowhere")]).count() == 0


def test_settings_and_queries(spark, tmp_path):
    toml = tmp_path / "config.toml"
    toml.write_text('roots = ["/x"]\nmax_content_mb = 5\nunknown = 1\n')
    assert settings.load(str(toml)).roots == ("/x",) and settings.load(str(toml)).max_content_mb == 5 and settings.load(None).max_chunks_per_file == 16
    lines = tmp_path / "q.jsonl"
    lines.write_text('# note\n\n{"query": "devis", "expected": ["~/a.pdf"]}\n')
    rows = settings.read_queries(spark, str(lines), "/home/u")
    assert rows.collect()[0].expected == ["/home/u/a.pdf"]
    settings.write_queries(rows.withColumn("source", F.lit("log")), str(tmp_path / "out"), "/home/u")
    assert spark.read.json(str(tmp_path / "out")).first().expected == ["~/a.pdf"]
    assert "| all | 0.500 | 50% |" in settings.report([{"variant": "all", "mrr": 0.5, "r1": 0.5, "r3": 1, "r10": 1, "p50": 1, "p95": 2}])

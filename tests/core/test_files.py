"""Files, the keyed table and the incremental import on literal files and rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import files
from sparkloom.sources.store import KeyedTable
from sparkloom.streaming import ingest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="Titre2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def par(text, style="", listed=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if listed else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{par(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


@pytest.mark.parametrize("code", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le"])
def test_round_trip(code):
    assert files.decode("plain text, ünd more".encode(code)) == "plain text, ünd more"
    assert files.decode("".encode(code)) == ""


def test_decode_marks():
    assert files.decode(b"\xfe\xff" + "ab".encode("utf-16-be") + b"\x00") == "ab"
    assert files.decode(b"a\xffb") == "a�b"


def test_docx():
    blocks, notes = files.docx_blocks(docx(par("One", "Heading1") + par("Two", "Titre2") + par("text &amp; more") + par("item", listed=True) + table(["a", "b|c"], ["1"]) + par("")))
    assert files.render(blocks) == "# One\n\n## Two\n\ntext & more\n\n- item\n\n| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert notes == [files.UNEVEN] and files.docx_blocks(docx("")) == ([], [])


def test_scan(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.md").write_text("# X\nbody")
    (tmp_path / "a/b/y.txt").write_bytes(b"\xff\xfe" + "wide".encode("utf-16-le"))
    (tmp_path / "a/z.docx").write_bytes(docx(par("T", "Heading1")))
    (tmp_path / "a/bad.docx").write_bytes(b"no zip")
    (tmp_path / "a/b/skip.md").write_text("no")
    (tmp_path / "a/code.py").write_text("no")
    found = files.scan(spark, str(tmp_path), (*files.DEFAULT, "!**/skip.*"))
    blank = spark.createDataFrame([("a/empty.md", b""), ("a/null.txt", None)], "path string, content binary")
    got = {r.path: r for r in files.documents(found.select("path", "content").union(blank)).collect()}
    assert {p: (r.text, r.status, r.quality, r.method) for p, r in got.items()} == {
        "a/x.md": ("# X\nbody", "indexed", "good", "markdown"), "a/b/y.txt": ("wide", "indexed", "good", "plain_text"), "a/z.docx": ("# T", "indexed", "good", "docx"),
        "a/bad.docx": ("", "failed", "unusable", "docx"), "a/empty.md": ("", "failed", "unusable", "markdown"), "a/null.txt": ("", "failed", "unusable", "plain_text"),
    }
    assert got["a/empty.md"].warnings == [files.EMPTY] and got["a/x.md"].content_hash == __import__("hashlib").sha256(b"# X\nbody").hexdigest()


def test_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "id")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    assert t.read() is None
    t.upsert(rows((1, "a"), (2, "b")))
    t.upsert(rows((2, "c"), (3, "d")))
    t.delete(rows((1, "")))
    assert sorted(tuple(r) for r in t.read().collect()) == [(2, "c"), (3, "d")]
    with pytest.raises(Exception):
        t.replace(rows((9, "late")), base=1)
    assert t.read().count() == 2


def test_stream(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "id")
    src = tmp_path / "in"

    def load(*rows):
        spark.createDataFrame(list(rows), "id long, text string, at long").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("id long, text string, at long").parquet(str(src))
        ingest.upsert_stream(stream, t, str(tmp_path / "c"), order="at").trigger(availableNow=True).start().awaitTermination(60)

    load((1, "a", 1), (1, "b", 2), (2, None, 1))
    load((2, "x", 3), (1, "b", 9))
    assert sorted(tuple(r) for r in t.read().select("id", "text", F.col("at")).collect()) == [(1, "b", 2), (2, "x", 3)]

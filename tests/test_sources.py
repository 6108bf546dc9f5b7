"""Readers on hand-built bytes, node tables, and folders."""

import pytest
from pyspark.sql import functions as F

from docblocks.readers import html as reader
from docblocks.readers.model import joined
from docblocks.sources import encoding, html, listing


@pytest.mark.parametrize(
    ("raw", "text", "name"),
    [("é".encode(), "é", "utf-8"), ("\ufeffé".encode(), "é", "utf-8"), ("é".encode("utf-16"), "é", "utf-16"), ("abc def".encode("utf-16-le"), "abc def", "utf-16-le"), ("abc def".encode("utf-16-be"), "abc def", "utf-16-be"), ("ação já".encode("cp1252"), "ação já", "cp1252"), (b"", "", "utf-8")],
)
def test_decode(spark, raw, text, name):
    assert encoding.decode(raw)[:2] == (text, name)
    row = spark.createDataFrame([(bytearray(raw),)], "c binary").select(encoding.decoded(F.col("c")).alias("d")).first()["d"]
    assert (row["text"], row["encoding"]) == (text, name)


def test_decode_tolerates_some_damage():
    text, name, warned, _ = encoding.decode("ação ação ação".encode() + b"\xff")
    assert name == "utf-8" and warned and text.startswith("ação")


def test_markdown_is_never_western_and_controls_are_errors():
    assert encoding.decode("já".encode("cp1252"), markdown=True)[1] == "utf-8"
    assert encoding.decode(b"a\0b\0\0c")[3] == encoding.CONTROLS
    assert encoding.decode(b"\x81\x8d\x8f")[3] == encoding.UNKNOWN


def test_declared_charset_wins(spark):
    raw = b'<html><meta charset="latin1"><p>a\xe7\xe3o</p>'
    assert encoding.decode_html(raw)[0].endswith("ação</p>")
    row = spark.createDataFrame([(bytearray(raw),), (None,)], "c binary").select(encoding.decoded(F.col("c"), html=True)["text"].alias("t")).collect()
    assert row[0]["t"].endswith("ação</p>") and row[1]["t"] is None


PAGE = "<html><head><title>x</title><script>bad()</script></head><body><h1>A</h1><p>b <b>c</b><p>d<br>e<ul><li>f<li>g</ul><table><tr><td>h<td>i<tr><td>j</table><dl><dt>k<dd>l<dt>m</dl>"


def test_pages():
    got = [(p.kind, p.text) for p in reader.paragraphs(PAGE)]
    assert got == [("p", "A"), ("p", "b c"), ("p", "d\ne"), ("bullet", "f"), ("bullet", "g"), ("cell", "h"), ("cell", "i"), ("cell", "j"), ("cell", ""), ("bullet", "k"), ("bullet", "l"), ("bullet", "m")]
    assert [p.text for p in reader.paragraphs("")] == [] and [p.text for p in reader.paragraphs("texto solto")] == ["texto solto"]


def test_nodes(spark):
    frame = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "k int, h string")
    rows = html.nodes(frame, "k", "h").where("k = 1").orderBy("node_id").collect()
    tags = [r["tag"] for r in rows]
    assert tags.count("li") == 2 and tags.count("tr") == 2 and "script" not in tags
    parents = {r["node_id"]: r for r in rows}
    assert all(r["depth"] == parents[r["parent_id"]]["depth"] + 1 for r in rows if r["parent_id"] is not None)
    assert [r["tag"] for r in html.nodes(frame, "k", "h").where("k > 1").collect()] == ["#document"] * 2


def test_emphasis_inherits_and_css_wins(spark):
    deep = "<div>" * 60 + "fim" + "</div>" * 60
    frame = spark.createDataFrame([(1, f'<p><b>a<i>b</i><span style="font-weight: normal">c</span></b>d</p><b>{deep}</b>')], "k int, h string")
    runs = html.merged_runs(html.nodes(frame, "k", "h").where("tag = '#text'"), "k", "node_id", ["bold", "italic"])
    assert [(r["text"], r["bold"], r["italic"]) for r in runs.orderBy("first").collect()] == [("a", True, False), ("b", True, True), ("cd", False, False), ("fim", True, False)]


def test_links_and_breaks():
    page = '<p>x <a href="https://a.example/(1) b">um <b>dois</b></a><br> <a href="javascript:x">não</a> <a href="#y">âncora</a></p>'
    runs = next(iter(reader.paragraphs(page))).runs
    assert [(r.text, r.href, r.bold) for r in joined(runs)] == [("x ", None, False), ("um ", "https://a.example/%281%29%20b", False), ("dois", "https://a.example/%281%29%20b", True), ("\nnão âncora", None, False)]


def test_listing(spark, tmp_path):
    for name in ("b.Md", "a.md", "~$b.docx", ".c.txt", "d_SEI.html", "e.xyz", "f.html"):
        (tmp_path / name).write_text("<title>Conteúdo formatado para o SEI</title>" if name == "f.html" else "x")
    assert [r["name"] for r in listing.raw_documents(spark, str(tmp_path)).orderBy("path").select("name").collect()] == ["a.md", "b.Md"]
    stream = listing.raw_stream(spark, str(tmp_path))
    assert stream.isStreaming
    query = stream.select("name").writeStream.format("memory").queryName("seen_files").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["name"] for r in spark.table("seen_files").collect()) == ["a.md", "b.Md"]

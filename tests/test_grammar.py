"""Entities, image headers, held tokens, typed marks and the inline grammar, against the standard or a brute-force reading."""

import html
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from docblocks.functions import entities, images
from docblocks.functions import tokens as K
from docblocks.operators import inline as I
from docblocks.operators import markdown as M
from docblocks.operators import reports as G

from .conftest import SF


def column(spark, fn, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in frame.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


# entities
def test_every_name_and_number(spark):
    names = list(html.entities.html5)
    numbers = [f"#{n}" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**12, 10**40]]
    numbers += [f"#x{n:x}" for n in (0, 9, 10, 13, 0x41, 0x80, 0x9F, 0x2014, 0x1F600, 0x110000)] + ["#X41", "#00065", "#x0041", "#", "#x", "#;", "#xg"]
    texts = [f"a&{n};b" for n in names if not n.endswith(";")] + [f"&{n}" for n in names] + [f"&{n}x" for n in names] + [f"{'&' + n}{end}" for n in numbers for end in (";", "", " ", "z", ";;")]
    texts += ["", "&", "&&amp;", "& amp;", "&amp;lt;", "&notit;", "&notin;", "&ampx;", "&copycat", "&nosuch;", "&ação;", "x &lt", "&" + "a" * 40 + ";", "&amp\n;", "no reference", None]
    assert column(spark, entities.unescape, texts) == [None if t is None else html.unescape(t) for t in texts]


def test_entities_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html", entities.unescape(F.col("html")).alias("out")).collect()
    assert pages and all(r["out"] == html.unescape(r["html"]) for r in pages)


# images
def jpeg(*segments):
    return b"\xff\xd8" + b"".join(segments)


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def frame_of(w, h, marker=0xC0):
    return segment(marker, b"\x08" + struct.pack(">HH", h, w) + b"\x03" + b"\x01\x11\x00" * 3)


@pytest.mark.parametrize(
    ("blob", "out"),
    [
        (b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 70000) + b"rest", (640, 70000)), (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0", None),
        (b"GIF89a" + struct.pack("<HH", 300, 7), (300, 7)), (b"GIF87a" + struct.pack("<HH", 1, 65535) + b"x", (1, 65535)), (b"GIF89a\x01", None),
        (jpeg(frame_of(800, 600)), (800, 600)), (jpeg(segment(0xE0, b"JFIF\0"), segment(0xE1, b"\xff\xc0" * 900), b"\xff\xff", frame_of(12, 34, 0xC2)), (12, 34)),
        (jpeg(frame_of(1, 2, 0xC4), frame_of(3, 4, 0xC8), frame_of(5, 6, 0xCC), frame_of(7, 8, 0xCF)), (7, 8)), (jpeg(frame_of(0, 5), frame_of(7, 8)), None),
        (jpeg(segment(0xE0, b"x"), b"\0", frame_of(7, 8)), None), (jpeg(), None), (jpeg(segment(0xE0, b"x" * 70)), None), (jpeg(frame_of(800, 600))[:11], None),
        (b"BM1234567890", None), (b"", None), (None, None),
    ],
)
def test_image_sizes(spark, blob, out):
    (got,) = column(spark, images.size, [blob], "binary")
    assert (got and tuple(got)) == out


def test_bytes_of_an_image_are_written_once(spark):
    """Not for every number that is read of them: the steps of a walk would put them together again and again."""
    from docblocks.plans import reference

    plan = reference.queries()["image_sizes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unhex(") == 1


# tokens
ALPHABET = ["\ue000", "\ue001", "\\", "*", "~", "[", "]", "(", ")", "<red>", "</red>", "a", " b ", "!", "ç", "\\*", "&", "\ue017", "0", "1", *[chr(0xE010 + i) for i in range(7)]]


def noise(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, n)))


def test_held_tokens_come_back(spark):
    rng = random.Random(1)
    texts = [noise(rng, 40) for _ in range(300)] + ["", "\ue000" * 9]
    back = lambda t: (lambda held: K.restore(held[1], held[0]))(K.hold(t, K.ESCAPE))
    assert column(spark, back, texts) == texts
    assert column(spark, lambda t: K.unshield(K.shield(t)), texts) == texts
    shielded = column(spark, K.shield, texts)
    assert not any(chr(0xE010 + i) in s for s in shielded for i in range(7)) and len(set(shielded)) == len(set(texts))


def test_typed_marks(spark):
    rng = random.Random(2)
    rows = [(i, noise(rng, 12), rng.randint(1, 12), rng.random() < 0.5, rng.choice(["sup", "sub", ""]), rng.randint(1, 100) / 2, [rng.randint(1, 99) / 4 for _ in range(rng.randint(0, 5))]) for i in range(200)]
    frame = spark.createDataFrame(rows, "i int, t string, n int, u boolean, v string, w double, c array<double>")
    plain = K.shield(F.col("t"))
    n, text = K.columns_of(K.with_columns(plain, F.col("n")))
    w, c = K.widths_of(K.with_widths(F.col("w"), F.col("c")))
    line = F.concat(plain, K.with_format(plain, F.col("u"), F.col("v")), F.lit("|"), K.with_format(plain, ~F.col("u"), F.lit("sup")))
    got = frame.select("*", n.alias("n2"), K.unshield(text).alias("t2"), w.alias("w2"), c.alias("c2"), F.transform(K.formats_of(line), lambda p: p.withField("text", K.unshield(p["text"]))).alias("p"), K.widths_of(plain)[0].alias("none")).collect()
    for r in got:
        assert (r["n2"], r["t2"], r["w2"], r["c2"], r["none"]) == (r["n"], r["t"], r["w"], r["c"], None)
        marked = r["u"] or r["v"] != ""
        parts = [(r["t"], r["u"], r["v"]), ("|", False, "")] if marked else [(r["t"] * 2 + "|", False, "")]
        parts = [(r["t"], False, "")] * marked + parts + [(r["t"], not r["u"], "sup")]
        assert "".join(p["text"] for p in r["p"]) == "".join(p[0] for p in parts)
        assert [tuple(p) for p in r["p"] if p["text"]] == [p for p in parts if p[0]]


# the grammar, read by recursion
def brute_emphasis(text, bold=False, italic=False, strike=False):
    out = []
    for part in re.split(r"(\*\*\*.+?\*\*\*|\*\*.*?\*\*|~~.*?~~|\*.*?\*)", text):
        inside = lambda n, **more: brute_emphasis(part[n : len(part) - n], **({"bold": bold, "italic": italic, "strike": strike} | more))  # noqa: B023, E731
        whole = lambda mark, least: part.startswith(mark) and part.endswith(mark) and len(part) >= least  # noqa: B023, E731
        if whole("***", 7):
            out += inside(3, bold=True, italic=True)
        elif whole("**", 4):
            out += inside(2, bold=True)
        elif whole("~~", 5):
            out += inside(2, strike=True)
        elif whole("*", 2):
            out += inside(1, italic=True)
        elif part:
            out.append((part, bold, italic, strike))
    return out


def brute_runs(text):
    """Runs by a recursive reading in which every held part is a private number."""
    held = []

    def hold(m):
        held.append(m[0][1:] if m[0][0] == "\\" else m[0])
        return f"\uf000{len(held) - 1}\uf001"

    def back(t):
        return re.sub("\uf000(\\d+)\uf001", lambda m: held[int(m[1])], t)

    bare = re.sub(r"\\[!-/:-@\[-`{-~]|[\ue000\ue001]", hold, text)
    out = []
    for n, passage in enumerate(re.split(r"(?s)<red>(.*?)</red>", bare)):
        links = []

        def link(m):
            links.append((m[1].strip() or m[2], m[2]))  # noqa: B023
            return f"\uf002{len(links) - 1}\uf003"  # noqa: B023

        for part, *style in brute_emphasis(re.sub(r"\[([^\]]*)\]\(((?:[^()]|\([^()]*\))+)\)", link, passage)):
            for k, piece in enumerate(re.split("\uf002(\\d+)\uf003", part)):
                color = "C00000" if n % 2 else None
                if k % 2:
                    out.append((back(links[int(piece)][0]), back(links[int(piece)][1]), color, *style))
                elif piece:
                    out.append((back(piece), None, color, *style))
    return out


def merged(runs):
    """Neighbours of one format as one: how text is cut between marks says nothing."""
    out = []
    for text, *style in runs:
        if out and out[-1][1:] == style and style[0] is None:
            out[-1][0] += text
        elif text or style[0] is not None:
            out.append([text, *style])
    return out


LINES = [
    "", "plain", "a **b *c* d** e", "***x*** ~~y **z**~~", "~~~~", "****", "*", "**a", r"\*não\* 1\. x", "<red>x [**a**](https://h/(1))</red> *[b](u)*", "[ ](u) [](v(w)) [x]()", "<red>a <red>b</red> c</red>", "a < b **c < d**",
    "**a <red>b** c</red>", r"\<red>x</red>", r"[a\]b](c\)d) \[e](f)", "*a **b ~~c [d](e) f~~ g** h*", "\ue000[\ue001](x\ue000y)\\*\ue001", "******", "*******", "**~~*a*~~**b*c*", "~~a~~b~~c", "![x](y) [[a](b)](c)", "[a\\](b)",
]


def test_runs(spark):
    rng = random.Random(3)
    texts = LINES + [noise(rng, 30) for _ in range(500)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "i int, text string, tokens int")
    got = {r["i"]: r["runs"] for r in I.runs(frame, "text").collect()}
    assert got.pop(len(texts)) is None
    for i, text in enumerate(texts):
        assert merged([list(r) for r in got[i]]) == merged([list(r) for r in brute_runs(text)]), text
    assert I.runs(frame, "text").columns == ["i", "text", "tokens", "runs"]


def test_visible(spark):
    frame = spark.createDataFrame([(r"**a** [*b*](u) ~~c~~ \* <red>d</red>",)], "t string")
    assert I.runs(frame, "t").select(I.visible(F.col("runs"))).first()[0] == "a b c * d"


@pytest.mark.parametrize(
    ("line", "out"),
    [
        ("x ![a *b*](c.png) y", r"x Imagem não incorporada (a \*b\*) y"), ("![ ](c)", "Imagem não incorporada (sem descrição)"), ("![](c)![d](e)", "Imagem não incorporada (sem descrição)Imagem não incorporada (d)"),
        ("[a](b) ! [c](d) !x", "[a](b) ! [c](d) !x"), ("", ""), ("![#1](c)", r"Imagem não incorporada (\#1)"),
    ],
)
def test_images_are_words(spark, line, out):
    assert column(spark, M.image_placeholders, [line]) == [out]


LONG = "Encaminhe-se o presente processo à unidade de origem para as providências que o caso requer e mais"


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("Atenciosamente,\n[Assinado eletronicamente]\nFulana\n\nChefe", ["Atenciosamente,", "[Assinado eletronicamente]", "Fulana", "Chefe"]),
        (f"a\nAssinado eletronicamente\nFulana\n{LONG}", [f"a\nAssinado eletronicamente\nFulana\n{LONG}"]), ("no mark\nhere", ["no mark\nhere"]), ("  (assinada  eletronicamente).  \n x ", ["(assinada  eletronicamente).", "x"]),
        (f"{LONG}\n\n{LONG}\n\\[Assinado eletronicamente\\]\nx", [f"{LONG}\n\n{LONG}", "\\[Assinado eletronicamente\\]", "x"]),
    ],
)
def test_signatures_in_lines(spark, text, out):
    assert column(spark, M.signature_lines, [text]) == [out]


def test_names_of_a_report_are_put_in_order_once(spark):
    """Outside the lines that are shown, not in each of them."""
    frame = spark.createDataFrame([(["erro em b.odt e ab", "x b.odt.", "nada"], ["b.odt", "ab.odt", "abc.pdf"])], "l array<string>, n array<string>").select(G.report_lines(F.col("l"), F.col("n"), 2).alias("o"))
    assert frame.first()["o"] == ["- erro em <arquivo> e ab", "- x <arquivo>.", "- e mais 1."]
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert plan.index("regexp_replace") < plan.index("slice(")


def test_signature_lines_are_computed_once(spark):
    """Every use of the lines, and the filter on an explode, would write their whole expression out again."""
    from docblocks.plans import reference

    plan = reference.queries()["signature_lines"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("assinado eletronicamente") == 1
    assert not [row for row in plan.splitlines() if "Filter" in row.split("(")[0] and "assinado" in row]


def test_the_runs_of_a_line_are_computed_once(spark):
    """Spark's filter on an explode would hold the whole inline grammar a second time."""
    from docblocks.plans import reference

    from .conftest import SF

    plan = reference.queries()["inline_runs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan
    assert not [row for row in plan.splitlines() if "Filter" in row.split("(")[0] and "aggregate(" in row]

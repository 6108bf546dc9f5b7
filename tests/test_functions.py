"""Small vectors for the scalar functions and the ordered folds."""

import random

import pytest
from pyspark.sql import functions as F

from docblocks.functions import text as T
from docblocks.operators import ordered as O
from docblocks.operators import tables as B
from docblocks.operators import validate


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_white_space_of_any_kind_is_stripped(spark):
    """The characters that are stripped are those of the pattern that words are divided at."""
    rows = spark.createDataFrame([(chr(n),) for n in range(0x10000) if not 0xD800 <= n < 0xE000], "c string")
    white = F.col("c").rlike(r"(?U)^\s$")
    assert rows.where((T.strip(F.concat("c", F.lit("x y"), "c", "c")) == "x y") != white).isEmpty()
    assert rows.where(white).count() == len(T.WHITE) == 25
    assert rows.where(white & (F.size(T.words(F.concat("c", F.lit("x"), "c", F.lit("y"), "c"))) != 2)).isEmpty()
    assert one(spark, T.words, " \n") == [] and one(spark, T.words) is None and one(spark, T.strip) is None


@pytest.mark.parametrize(("n", "kind", "out"), [(3, "1", "3."), (3, "a", "c)"), (27, "a", "aa)"), (2, "A", "B)"), (4, "i", "iv -"), (1994, "I", "MCMXCIV -"), (0, "a", "0)")])
def test_item_number(spark, n, kind, out):
    assert one(spark, lambda x: T.item_number(x, F.lit(kind)), n, "int") == out


@pytest.mark.parametrize(("url", "out"), [("https://a.example", "https://a.example"), ("JavaScript:x", None), ("java\tscript:x", None), ("mailto:a@b", "mailto:a@b"), ("pasta/a.html", "pasta/a.html"), ("", None), (" \t", None), (None, None), (" https://a/b c\n", "https://a/b c"), ("da ta:x", None), ("a_b:c", "a_b:c"), ("TEL:1", "TEL:1")])
def test_safe_url(spark, url, out):
    assert one(spark, T.safe_url, url) == out


@pytest.mark.parametrize(("url", "out"), [("https://a/b c(d)", "https://a/b%20c%28d%29"), ("#x", None), (" #x", None), ("javascript:(1)", None), ("x y", "x%20y"), ("", None), (None, None)])
def test_link_target(spark, url, out):
    assert one(spark, T.link_target, url) == out


@pytest.mark.parametrize(("line", "depth"), [("1. Título", 1), ("1.1 Texto", 2), ("2026 foi", 0), ("3.1.2. x", 3), ("1.x", 0), ("", 0), ("texto", 0)])
def test_item_depth(spark, line, depth):
    assert one(spark, T.item_depth, line) == depth


@pytest.mark.parametrize(("line", "prose"), [("1. ASSUNTO", False), ("3. Conclusão", False), ("1. Trata-se de pedido, conforme o ofício.", True), ("1. Uma frase com mais de oito palavras sem nenhum ponto", True), ("Curto.", False), ("", False)])
def test_prose(spark, line, prose):
    assert one(spark, T.is_prose, line) is prose


def test_excerpt_counts_words_between_any_space(spark):
    assert one(spark, T.excerpt, " ".join("palavra" for _ in range(13))) == " ".join(["palavra"] * 12) + "…"
    assert one(spark, T.excerpt, "a b") == "a b"
    assert one(spark, T.excerpt, "  ") == ""


@pytest.mark.parametrize(("text", "caps"), [("ÀB C", True), ("AB", False), ("ABc", False), ("123 ABC!", True)])
def test_caps(spark, text, caps):
    assert one(spark, T.is_caps, text) is caps


def test_lengths(spark):
    assert one(spark, T.centimetres, "72pt") == pytest.approx(2.54)
    assert one(spark, T.centimetres, "3 %") is None


def test_crc16(spark):
    assert one(spark, T.crc16, "123456789") == "29B1"


def test_style_names(spark):
    assert one(spark, T.odf_style_name, "Item_5f_Nivel1") == "Item_Nivel1"


LONG = "x" * 120


@pytest.mark.parametrize(
    ("texts", "out"),
    [
        ([f"“{LONG}”."], [0]),
        (["“curta”."], []),
        (["“abre", "meio", "fecha” (art. 1)."], [0, 1, 2]),
        (["“abre", "“meio", "“fecha”"], [0, 1, 2]),
        (["“abre", None, "fecha”"], []),
        (["“abre", "fecha” e segue o texto"], []),
        (["“nunca fecha", "fim"], []),
        (["“a", "b”", "c", "“d", "e”"], [0, 1, 3, 4]),
        (["texto “no meio", "fecha”"], []),
        ([f"“{LONG}” e “{LONG}”"], []),
    ],
)
def test_quoted_spans(spark, texts, out):
    assert one(spark, O.quoted_spans, texts, "array<string>") == out


MARK = "[assinado eletronicamente]"


@pytest.mark.parametrize(
    ("flags", "short", "n"),
    [
        ([False, True, True], [None, None, None], 2),
        ([True, True], [None, None], 0),
        ([False, False, False, False], [None, MARK, "Nome", "Cargo"], 3),
        ([False, False], [None, MARK], 0),
        ([False, True, True, True, True], [None, "Local", MARK, "Nome", "Cargo"], 4),
        ([False, False, False, False, False], [None, MARK, "De acordo.", MARK, "Nome"], 2),
        ([False, False, False], [None, "Atenciosamente,", "Nome"], 0),
    ],
)
def test_signature_tail(spark, flags, short, n):
    frame = spark.createDataFrame([(flags, short)], "a array<boolean>, b array<string>")
    assert frame.select(O.signature_tail(F.col("a"), F.col("b"))).first()[0] == n


@pytest.mark.parametrize(("lines", "out"), [(["1", ".", "2", ".", "Texto"], ["1.2. Texto"]), (["1.1.", "", "Texto"], ["1.1. Texto"]), (["a", "", "b"], ["a", "", "b"]), (["a", "3."], ["a", "3."])])
def test_number_glue(spark, lines, out):
    assert one(spark, O.glue_numbers, lines, "array<string>") == out


@pytest.mark.parametrize(("lines", "out"), [(["```", "a", "```"], [True] * 3), (["```", "a"], [False] * 2), (["````", "```", "````", "b"], [True, True, True, False]), (["a", "```py", "x", "```"], [False, True, True, True])])
def test_fences(spark, lines, out):
    assert one(spark, O.fence_blocks, lines, "array<string>") == out


def test_list_levels(spark):
    assert one(spark, O.list_levels, [1, 3, 2, 0, 1], "array<int>") == [0, 1, 1, 0, 0]


def test_regroup(spark):
    lines = ["ÓRGÃO", "UNIDADE", "1. Trata-se de", "pedido.", "CONCLUSÃO", "fim do", "texto", "", "outro"]
    frame = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, pos int, line string")
    got = [(r["kind"], r["text"]) for r in O.regroup(frame, "doc_id", "pos", "line").orderBy("first").collect()]
    assert got == [("cabecalho", "ÓRGÃO"), ("cabecalho", "UNIDADE"), ("corpo", "1. Trata-se de pedido."), ("corpo", "CONCLUSÃO"), ("corpo", "fim do texto"), ("corpo", "outro")]


def test_column_widths_add_up(spark):
    cells = spark.createDataFrame([(1, 0, "nº"), (1, 1, "uma descrição bem comprida " * 6), (1, 2, "valor")], "t int, c int, x string")
    got = {r["c"]: r["width"] for r in B.content_widths(cells, "t", "c", "x").collect()}
    assert sum(got.values()) == pytest.approx(100) and got[1] > got[2] >= 5 and got[0] >= 5


@pytest.mark.parametrize(
    ("html", "names"),
    [
        ('<p class="Item_Nivel1">a</p><p class="Item_Nivel2">b</p>', []),
        ('<p class="Item_Nivel2">a</p>', ["first_level"]),
        ('<p class="Item_Nivel1">a</p><p class="Item_Nivel3">b</p>', ["level_jump"]),
        ('<p class="Nenhuma">[x](https://a)</p>', ["class", "link"]),
        ("<div><li>a</li></div>", ["tag", "list_item"]),
        ('<p class="Texto_Mono_Espaçado">``` [x](https://a)</p>', []),
    ],
)
def test_warnings(spark, html, names):
    assert one(spark, validate.warnings, html) == names


PLATFORM = [
    "a\n\nNota Técnica 110 (123)  SEI 80000.1/2024-1 / pg. 1\n\nb", "a\nDespacho 6900388\nb", "a\n[assinado eletronicamente]\n( Assinatura Eletrônica )\nb", "x Documento assinado eletronicamente por A,\nem 2024, código CRC 0AF3. y",
    "Documento assinado eletronicamente por B, conforme\no Decreto nº 10.543, de 2020, art. 4. Fim.\nz", "A autenticidade do documento pode ser conferida no site, informando o código verificador 1. Ok.\nz", "Referência: Caso responda, cite\nreferência: Processo nº 1\nReferência: outro",
    "SEI 1.2/2024-3 / pg. 7\na", "a\nSEI 1/pg. 2 segue\nb", "Ofício 123\nOfício 123456\nTermo  de Referência 1234567\nTermo 1234567", "a\n\n\n\nb\n\n", "", "  \n\t\n", "Documento assinado eletronicamente por ninguém",
    "a\n\nrodapé SEI 1 / pg. 1\n\n\nDespacho 1234567\nb\n\nrodapé SEI 1 / pg. 2\nc",
]


def test_boilerplate_is_cleaned_as_by_the_reader(spark):
    from docblocks.readers.pdf import without_boilerplate

    rng = random.Random(4)
    texts = PLATFORM + ["\n".join(rng.choice(PLATFORM + ["uma linha", "  outra ", ""]) for _ in range(6)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.clean_boilerplate(F.col("t")).alias("o")).orderBy("i").collect()
    found = [r["o"] for r in rows]
    assert found[:3] == ["a\nb\n", "a\n\nb\n", "a\n\nb\n"] and found[3] == "x  y\n" and found[9] == "Ofício 123\n\nTermo 1234567\n" and found[14] == "a\n\nb\nc\n"
    different = [(t, a, b) for t, a, b in zip(texts, found, map(without_boilerplate, texts), strict=True) if a != b and "segue" not in t]
    assert not different


def test_boilerplate_lines_are_looked_at_once(spark):
    """A line's plain form is written once, not for every rule that asks for it."""
    plan = spark.range(1).select(T.clean_boilerplate(F.col("id").cast("string")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


def test_a_struck_item_is_struck_as_a_whole(spark, tmp_path):
    """whole_strike asks for the marks alone; that an item stays an item is is_struck's."""
    from docblocks.plans import reference

    spark.createDataFrame([(1, "56.187.231.175 texto\nx\n1. item")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["pos"]: r["struck"] for r in reference.queries()["whole_strike"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_half_a_tenth_goes_to_the_even_one_whatever_the_order_of_the_sums(spark):
    """2469.5 / 110 is 22.45: 22.4, though the sum of the shares ends a few bits off 110."""
    rows = spark.createDataFrame([([16.0, 16.0, 16.0, 15.0], [826.0, 152.0, 386.0, 699.0])], "n array<double>, w array<double>")
    assert rows.select(B.content_shares(F.col("n"), F.col("w")).alias("p")).first()[0] == [31.8, 17.5, 22.4, 28.3]

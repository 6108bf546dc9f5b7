"""The whole conversion on hand-built files of every format, and the batch over a folder."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docblocks import pipeline, sinks
from docblocks.readers import inline, markdown, pdf, read
from docblocks.readers.model import joined

BODY = pipeline.Options(body_only=True)


def convert(spark, files, options=BODY):
    rows = [(i, name, f".{name.rsplit('.', 1)[-1].lower()}", bytearray(raw if isinstance(raw, bytes) else raw.encode())) for i, (name, raw) in enumerate(files)]
    frame = spark.createDataFrame(rows, "doc_id long, name string, suffix string, content binary")
    found = pipeline.convert(frame, options).orderBy("doc_id").collect()
    return [(r, r["arquivos"][0]["conteudo"].rstrip("\n").split("\n") if r["arquivos"] else None) for r in found]


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, body in members.items():
            archive.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels/", "_rels/").replace("_png", ".png"), body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def run(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def par(*runs, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(runs)}</w:p>"


def cell(*paragraphs, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{''.join(paragraphs)}</w:tc>"


STYLES = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="N"/><w:rPr><w:b/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="E"><w:name w:val="Texto Ementa"/></w:style>
<w:style w:type="paragraph" w:styleId="Q"><w:name w:val="Recuado"/><w:basedOn w:val="N"/><w:pPr><w:ind w:left="2268"/></w:pPr><w:rPr><w:sz w:val="20"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Q2"><w:name w:val="Filho"/><w:basedOn w:val="Q"/></w:style>
<w:style w:type="character" w:styleId="S"><w:name w:val="Forte"/><w:rPr><w:b/><w:strike/></w:rPr></w:style></w:styles>"""
NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>
<w:abstractNum w:abstractNumId="4"><w:lvl w:ilvl="0"><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="3"/></w:num><w:num w:numId="8"><w:abstractNumId w:val="4"/></w:num></w:numbering>"""


def numbered(num, level):
    return f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>'


def docx(body, **more):
    members = {"word__document_xml": f"<w:document {W}><w:body>{body}<w:sectPr><w:pgSz w:w=\"11906\"/><w:pgMar w:left=\"1418\" w:right=\"1418\"/></w:sectPr></w:body></w:document>", "word__styles_xml": STYLES, "word__numbering_xml": NUMBERING}
    return packed(**members, **more)


def test_markdown_blocks(spark):
    text = "# Nota\r\n\r\n1. ASSUNTO\n1.1. Trata de **x *y* z**.\n\n- a\n  - b\n- [x] c\n\n> q\n\n---\n\n~~fora~~\n\n```py\na  < b\n```\n<p class=\"Texto_Ementa\">e<br>f</p>\n| A | B |\n|---|---|\n| 1 | x \\| y |\n"
    ((row, lines),) = convert(spark, [("n.md", text)])
    assert row["sucesso"] and row["avisos"] == [] and row["cabecalho_trechos"] == ["Nota"] and row["cabecalho_paragrafos"] == 1
    assert lines[:9] == [
        '<p class="Texto_Centralizado_Maiusculas_Negrito"><strong>Nota</strong></p>', '<p class="Item_Nivel1">ASSUNTO</p>', '<p class="Item_Nivel2">Trata de <strong>x </strong><strong><em>y</em></strong><strong> z</strong>.</p>',
        '<ul><li class="Texto_Justificado">a<ul><li class="Texto_Justificado">b</li></ul></li><li class="Texto_Justificado">Concluído: c</li></ul>', '<p class="Citação">q</p>', '<p class="Tachado">fora</p>',
        '<p class="Texto_Mono_Espaçado">a  &lt; b</p>', '<p class="Texto_Ementa">e<br />f</p>', '<table align="center" border="1" cellpadding="1" cellspacing="1" width="100%">',
    ]
    assert '<p class="Tabela_Texto_Alinhado_Esquerda">x | y</p>' in lines and sum("width=" in x and "<td" in x for x in lines) == 2


def test_plain_text_has_no_quotes_or_strikes(spark):
    ((row, lines),) = convert(spark, [("n.txt", "> 18 anos\n~~x~~\nC:\\dados\\(1)\n")])
    assert lines == ['<p class="Texto_Justificado">&gt; 18 anos</p>', '<p class="Texto_Justificado">~~x~~</p>', '<p class="Texto_Justificado">C:\\dados\\(1)</p>']


def test_convention_of_numbered_paragraphs(spark):
    text = "\n".join(f"{i}. Trata-se de um pedido, conforme o ofício número {i}, que segue em anexo." for i in range(1, 4)) + "\n1.1. Sub item com texto corrido, e vírgula, para valer."
    ((_, lines),) = convert(spark, [("n.md", text)])
    assert [x.split('"')[1] for x in lines] == ["Paragrafo_Numerado_Nivel1"] * 3 + ["Paragrafo_Numerado_Nivel2"]


def test_quotations_are_counted_and_made_if_asked(spark):
    text = "texto\n\n“abre a citação\n\nno meio\n\ne fecha” (art. 1º).\n"
    ((plain, lines),) = convert(spark, [("n.md", text)])
    assert plain["citacoes_entre_aspas"] == 3 and not any("Citação" in x for x in lines) and plain["citacoes_trechos"][0] == "“abre a citação"
    ((_, lines),) = convert(spark, [("n.md", text)], pipeline.Options(body_only=True, quotes=True))
    assert [x.split('"')[1] for x in lines] == ["Texto_Justificado"] + ["Citação"] * 3


def test_signature_at_the_end(spark):
    ((_, lines),) = convert(spark, [("n.txt", "Texto do despacho que precede a assinatura, com mais palavras do que cabem numa linha curta.\n\nAtenciosamente,\n\n(Assinado eletronicamente)\nFulana\nCargo\n[assinada eletronicamente].\nBeltrano\n")])
    sign = '<p class="Tabela_Texto_Centralizado">'
    assert lines[2:] == [f"{sign}<em>[Assinado eletronicamente]</em></p>", f"{sign}Fulana</p>", f"{sign}Cargo</p>", f"{sign}&nbsp;</p>", f"{sign}<em>[Assinado eletronicamente]</em></p>", f"{sign}Beltrano</p>"]


def test_word_runs_styles_lists_and_notes(spark):
    body = (
        par(run("Um título"), props='<w:pStyle w:val="H1"/>')
        + par(run("a", "<w:b/>"), run("b", '<w:rStyle w:val="S"/>'), run("c", '<w:i w:val="0"/><w:u w:val="single"/><w:color w:val="FF0000"/>'), run("2", '<w:vertAlign w:val="superscript"/>'), "<w:del><w:r><w:delText>velho</w:delText></w:r></w:del>", f"<w:ins>{run(' novo')}</w:ins>", '<w:r><w:footnoteReference w:id="5"/></w:r>')
        + par(run("ementa"), props='<w:pStyle w:val="E"/>')
        + par(run("um"), props=numbered(7, 0)) + par(run("dois"), props=numbered(7, 1)) + par(run("alínea"), props=numbered(8, 0)) + par(run("item"), props=numbered(99, 0))
        + par(run("recuado e menor que o corpo do texto"), props='<w:pStyle w:val="Q2"/>')
        + par(run("CENTRO"), props='<w:jc w:val="center"/>') + par(run("com recuo de primeira linha"), props='<w:ind w:firstLine="700"/>')
        + f'<w:p><w:hyperlink r:id="L1">{run("clique", "<w:u w:val=&quot;single&quot;/>".replace("&quot;", chr(34)))}</w:hyperlink></w:p>'
    )
    rels = '<Relationships><Relationship Id="L1" Type="x/hyperlink" Target="https://a.example/?x=1&amp;y=2"/><Relationship Id="F" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/footnotes" Target="footnotes.xml"/></Relationships>'
    notes = f'<w:footnotes {W}><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="5"><w:p>{run("a nota")}</w:p><w:p>{run("segue")}</w:p></w:footnote></w:footnotes>'
    raw = packed(**{"word__document_xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word__styles_xml": STYLES, "word__numbering_xml": NUMBERING, "word__footnotes_xml": notes})
    with zipfile.ZipFile(io.BytesIO(raw)) as old:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as new:
            for name in old.namelist():
                new.writestr(name, old.read(name))
            new.writestr("word/_rels/document.xml.rels", rels)
    ((row, lines),) = convert(spark, [("w.docx", out.getvalue())])
    assert row["citacoes_por_recuo"] == 1 and len(row["avisos"]) == 1
    assert lines == [
        '<p class="Item_Nivel1">Um título</p>',
        '<p class="Texto_Justificado"><strong>a</strong><strong><s>b</s></strong><span style="color:#FF0000"><u>c</u></span><sup>2</sup> novo[1]</p>',
        '<p class="Texto_Ementa">ementa</p>',
        '<ul><li class="Texto_Justificado">um<ul><li class="Texto_Justificado">dois</li></ul></li></ul>',
        '<p class="Item_Alinea_Letra">alínea</p>',
        '<p class="Item_Nivel2">item</p>',
        '<p class="Texto_Justificado">recuado e menor que o corpo do texto</p>',
        '<p class="Texto_Centralizado_Maiusculas">CENTRO</p>',
        '<p class="Texto_Justificado_Recuo_Primeira_Linha">com recuo de primeira linha</p>',
        '<p class="Texto_Justificado"><a href="https://a.example/?x=1&amp;y=2">clique</a></p>',
        '<p class="Texto_Centralizado"><strong>Notas</strong></p>',
        '<p class="Texto_Justificado">Nota 1: a nota / segue</p>',
    ]


def test_word_tables(spark):
    grid = '<w:tblPr><w:tblW w:type="pct" w:w="2500"/></w:tblPr><w:tblGrid><w:gridCol w:w="1000"/><w:gridCol w:w="3000"/><w:gridCol w:w="1000"/></w:tblGrid>'
    rows = [
        cell(par(run("A"))) + cell(par(run("B")), props='<w:gridSpan w:val="2"/>'),
        cell(par(run("v")), props='<w:vMerge w:val="restart"/>') + cell(par(run("x"), props='<w:jc w:val="right"/>')) + cell(par()),
        cell(par(), props="<w:vMerge/>") + cell(par(run("y", '<w:sz w:val="16"/>'))) + cell(par(run("p")), par(run("q"))),
    ]
    ((_, lines),) = convert(spark, [("t.docx", docx(f"<w:tbl>{grid}{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>"))])
    assert lines[0].endswith('width="50%">')
    cells = [x.strip() for x in lines if "<td" in x]
    assert cells[:2] == ['<td width="20.0%" style="vertical-align:middle; background-color:#e6e6e6;">', '<td width="80.0%" colspan="2" style="vertical-align:middle; background-color:#e6e6e6;">']
    assert cells[2] == '<td rowspan="2" style="vertical-align:middle;">' and len(cells) == 7
    inside = [x for x in lines if x.startswith("<p")]
    assert inside == [f'<p class="Tabela_Texto_{c}">{t}</p>' for c, t in (("Centralizado", "<strong>A</strong>"), ("Centralizado", "<strong>B</strong>"), ("Alinhado_Esquerda", "v"), ("Alinhado_Direita", "x"), ("Centralizado", "&nbsp;"), ("8", "y"), ("Alinhado_Esquerda", "p"), ("Alinhado_Esquerda", "q"))]


NS = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in (("office", "office"), ("text", "text"), ("style", "style"), ("table", "table"), ("fo", "xsl-fo-compatible")))


def odt(body, styles=""):
    return packed(content_xml=f'<office:document {NS} xmlns:xlink="http://www.w3.org/1999/xlink"><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document>')


def test_open_document(spark):
    styles = (
        '<style:style style:name="P1" style:family="paragraph" style:parent-style-name="Heading_20_2"/><style:style style:name="P2" style:family="paragraph" style:parent-style-name="Item_5f_Nivel1"/>'
        '<style:style style:name="P3" style:family="paragraph"><style:paragraph-properties fo:text-align="end"/></style:style><style:style style:name="T1" style:family="text"><style:text-properties fo:font-weight="bold"/></style:style>'
        '<style:style style:name="C1" style:parent-style-name="C2"/><style:style style:name="C2" style:parent-style-name="C1"/>'
        '<text:list-style style:name="L1"><text:list-level-style-number text:level="1" style:num-format="a" style:num-suffix=")" text:start-value="3"/></text:list-style>'
    )
    body = (
        '<text:h text:outline-level="1">Geral</text:h><text:p text:style-name="P1">Filho</text:p><text:p text:style-name="P2">Do estilo</text:p><text:p text:style-name="P3">à direita</text:p><text:p text:style-name="C1">ciclo</text:p>'
        '<text:p>um<text:s text:c="2"/><text:span text:style-name="T1">dois</text:span><text:line-break/><text:a xlink:href="https://a.example">elo</text:a><text:note><text:note-citation>1</text:note-citation><text:note-body><text:p>nota</text:p></text:note-body></text:note></text:p>'
        '<text:list text:style-name="L1"><text:list-item><text:p>c</text:p></text:list-item><text:list-item><text:p>d</text:p><text:list><text:list-item><text:p>sub</text:p></text:list-item></text:list></text:list-item></text:list>'
        '<table:table><table:table-row><table:table-cell><text:p>A</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"><text:p>B</text:p></table:table-cell><table:table-cell table:number-columns-repeated="900"/></table:table-row>'
        '<table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-spanned="3"><text:p>z</text:p></table:table-cell></table:table-row></table:table>'
    )
    ((row, lines),) = convert(spark, [("o.odt", odt(body, styles))])
    assert len(row["avisos"]) == 1 and row["sucesso"]
    assert [x for x in lines if x.startswith(("<p", "<ul")) and "Tabela" not in x] == [
        '<p class="Item_Nivel1">Geral</p>', '<p class="Item_Nivel2">Filho</p>', '<p class="Item_Nivel1">Do estilo</p>', '<p class="Texto_Alinhado_Direita">à direita</p>', '<p class="Texto_Justificado">ciclo</p>',
        '<p class="Texto_Justificado">um  <strong>dois</strong><br /><a href="https://a.example">elo</a>[1]</p>', '<p class="Texto_Justificado">c) c</p>', '<p class="Texto_Justificado">d) d</p>', '<ul style="margin-left:2em"><li class="Texto_Justificado">sub</li></ul>',
        '<p class="Texto_Centralizado"><strong>Notas</strong></p>', '<p class="Texto_Justificado">Nota 1: nota</p>',
    ]
    assert sum("<tr>" in x for x in lines) == 3 and sum('colspan="3"' in x for x in lines) == 2


def test_pages(spark):
    html = (
        "<h1>Doc</h1><h2>1. Item</h2><p class='Texto_Ementa'>e</p><div style='text-align:center'>centro <b style='font-weight:normal'>leve</b></div><ol type=a start=2><li>x<li value=5>y</ol><blockquote><p>q</p></blockquote>"
        "<pre>a\n  b</pre><table width='80%'><tr><th width='25%'>h<td width='75%'>k<tr><td colspan=2 align=right>z</table><p>Documento assinado eletronicamente por A</p><img src=x><p><s>riscado</s></p>"
    )
    ((row, lines),) = convert(spark, [("p.html", html)])
    assert len(row["avisos"]) == 2
    assert [x for x in lines if x.startswith("<p") and "Tabela" not in x] == [
        '<p class="Texto_Centralizado_Maiusculas_Negrito"><strong>Doc</strong></p>', '<p class="Item_Nivel1"><strong>Item</strong></p>', '<p class="Texto_Ementa">e</p>', '<p class="Texto_Centralizado">centro leve</p>', '<p class="Texto_Justificado">b) x</p>', '<p class="Texto_Justificado">e) y</p>',
        '<p class="Citação">q</p>', '<p class="Texto_Mono_Espaçado">a<br />  b</p>', '<p class="Tachado">riscado</p>',
    ]
    assert any('width="80%"' in x for x in lines) and any('<td width="25.0%"' in x for x in lines) and '<p class="Tabela_Texto_Alinhado_Direita">z</p>' in lines


def made_pdf(text):
    content = b"BT /F1 12 Tf 50 700 Td " + b" ".join(b"(" + line.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj 0 -14 Td" for line in text.split("\n")) + b" ET"
    data = zlib.compress(content)
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>"


def test_pdf_text_is_read_cleaned_and_structured(spark):
    text = "ÓRGÃO PÚBLICO\nUnidade\n1.\nASSUNTO\n1.1.\nTrata-se de pedido (um)\nque segue\nNota 1 SEI 80000.1/2024-1 / pg. 1\nna outra página.\nCONCLUSÃO\nFim.\nDocumento assinado eletronicamente por X, em 2024, código CRC 0AF3."
    assert pdf.text_of(made_pdf(text)).split("\n")[:2] == ["ÓRGÃO PÚBLICO", "Unidade"]
    rows = convert(spark, [("d.pdf", made_pdf(text)), ("vazio.pdf", made_pdf("")), ("ruim.pdf", b"nada")])
    assert rows[0][1] == [
        '<p class="Texto_Centralizado">ÓRGÃO PÚBLICO</p>', '<p class="Texto_Centralizado">Unidade</p>', '<p class="Item_Nivel1"><strong>ASSUNTO</strong></p>', '<p class="Item_Nivel2">Trata-se de pedido (um) que segue na outra página.</p>',
        '<p class="Texto_Centralizado_Maiusculas_Negrito"><strong>CONCLUSÃO</strong></p>', '<p class="Texto_Justificado">Fim.</p>',
    ]
    assert "OCR" in rows[1][0]["erros"][0] and "danificado" in rows[2][0]["erros"][0]
    recognised = pipeline.convert_bytes(spark, "d.pdf", b"", BODY, recognised="1. ASSUNTO\ntexto lido")
    assert recognised["sucesso"] and len(recognised["avisos"]) == 2
    assert pipeline.convert_bytes(spark, "d.pdf", b"", BODY, recognised=" ")["erros"][0].endswith(read.OCR_EMPTY)


def test_bad_files_are_rows(spark):
    rows = convert(spark, [("a.docx", b"x"), ("b.odt", packed(styles_xml="<x/>")), ("c.rtf", b""), ("d.zip", b""), ("e.md", ""), ("f.txt", b"a\0\0b\0"), ("g.md", "ok")])
    assert [r["sucesso"] for r, _ in rows] == [False] * 6 + [True]
    assert all(len(r["erros"]) == 1 and r["nome_origem"] in r["erros"][0] for r, _ in rows[:6])


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("a **b *c* d** e", [("a ", ""), ("b ", "b"), ("c", "bi"), (" d", "b"), (" e", "")]),
        ("***x*** ~~y **z**~~", [("x", "bi"), (" ", ""), ("y ", "s"), ("z", "bs")]),
        ("~~a b~~", [("a b", "s")]),
        (r"\*não\* 1\. x", [("*não* 1. x", "")]),
        ("sem fim *", [("sem fim *", "")]),
        ("a * b", [("a * b", "")]),
        ("", []),
    ],
)
def test_inline_marks(text, out):
    assert [(r.text, "b" * r.bold + "i" * r.italic + "s" * r.strike) for r in joined(inline.runs(text))] == out


def test_inline_links_and_red():
    found = joined(inline.runs("<red>x [**a**](https://h/(1))</red> *[b](u)*"))
    assert [(r.text, r.href, r.color, r.italic) for r in found] == [("x ", None, "C00000", False), ("**a**", "https://h/(1)", "C00000", False), (" ", None, None, False), ("b", "u", None, True)]


def test_cells_keep_escaped_pipes():
    assert markdown.cells_of(r"| a \| b | | c |") == [r"a \| b", "", "c"]


def test_titles_and_lists_of_odt_end_quotations(spark):
    """A span of quotation marks goes over paragraphs only; in the second half a title and a list stand between."""
    p = lambda t: f"<text:p>{t}</text:p>"
    plain = odt(p("\u201cabre aqui") + p("segue o texto") + p("e fecha\u201d."))
    titled = odt(p("\u201cabre aqui") + '<text:h text:outline-level="1">TITULO</text:h>' + p("e fecha\u201d."))
    listed = odt(p("\u201cabre aqui") + "<text:list><text:list-item>" + p("item") + "</text:list-item></text:list>" + p("e fecha\u201d."))
    rows = convert(spark, [("a.odt", plain), ("b.odt", titled), ("c.odt", listed)], pipeline.Options(quotes=True))
    assert [r["citacoes_entre_aspas"] for r, _ in rows] == [3, 0, 0]


def test_header_can_be_left_out(spark):
    ((row, lines),) = convert(spark, [("n.md", "# T\n\nProcesso\n\n1. A\n\nb")], pipeline.Options(body_only=True, skip_header=True))
    assert row["cabecalho_paragrafos"] == 2 and lines == ['<p class="Item_Nivel1">A</p>', '<p class="Texto_Justificado">b</p>']


def test_warnings_of_the_validator(spark):
    ((row, _),) = convert(spark, [("n.md", "1.1. Sem o nível um antes dele\n\n1.1.1.1. salto\n\n![x](y.png)")], pipeline.Options())
    assert row["avisos"][0] == markdown.NO_IMAGES and any("começa no nível 2" in x for x in row["avisos"]) and any("salta do nível 2 para o 4" in x for x in row["avisos"])


def test_folders_are_converted_once_a_target(spark, tmp_path):
    inside, out = tmp_path / "in", tmp_path / "out"
    (inside / "sub").mkdir(parents=True)
    for name, text in (("a.md", "um"), ("a.txt", "dois"), ("B.MD", "três"), ("c.docx", "ruim"), ("sub/d.txt", "quatro"), ("e_SEI.html", "saída")):
        (inside / name).write_text(text)
    done = sinks.convert_folder(spark, str(inside), str(out), recursive=True)
    rows = done.results.orderBy("path").collect()
    assert [(r["nome_origem"], r["sucesso"]) for r in rows] == [("B.MD", True), ("a.md", True), ("a.txt", False), ("c.docx", False), ("d.txt", True)]
    assert done.written == 3 and "coincide com a de a.md" in rows[2]["erros"][0]
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*.html")) == ["B_SEI.html", "a_SEI.html", "sub/d_SEI.html"]
    assert "<p class=\"Texto_Justificado\">um</p>" in (out / "a_SEI.html").read_text()
    total = sinks.report(done.results).first()
    assert (total["documents"], total["converted"], total["failed"], total["exit_status"]) == (5, 3, 2, 1)
    assert json.loads(sinks.as_json(done.results.where("sucesso")).first()["json"])["sucesso"] is True
    first, lines, last = sinks.text_report(done.results, pipeline.Options(skip_header=True))
    text = [r["line"] for r in lines.collect()]
    assert first[1] == "RELATÓRIO DE CONVERSÃO PARA O SEI" and last[1] == "Total processados: 5 | Sucessos: 3 | Falhas: 2"
    assert text[0] == f"OK   B.MD -> {out}/B_SEI.html" and "FALHA a.txt:" in text and "     cabeçalho: Nenhum parágrafo foi omitido: o documento não tem item 1 depois de um cabeçalho." in text


def test_a_target_goes_to_the_first_that_converts(spark, tmp_path):
    """An input that can't be read takes no target from the next one."""
    for name, text in (("a.docx", "ruim"), ("a.md", "um"), ("a.txt", "dois")):
        (tmp_path / name).write_text(text)
    done = sinks.convert_folder(spark, str(tmp_path), str(tmp_path / "out"))
    rows = {r["nome_origem"]: r for r in done.results.collect()}
    assert [rows[n]["sucesso"] for n in ("a.docx", "a.md", "a.txt")] == [False, True, False] and done.written == 1
    assert "coincide com a de a.md" in rows["a.txt"]["erros"][0] and "coincide" not in rows["a.docx"]["erros"][0]
    assert "um" in (tmp_path / "out/a_SEI.html").read_text()


@pytest.mark.parametrize("level", [0, 5, -1, "x"])
def test_levels_are_bounded(level):
    with pytest.raises(ValueError, match="use um número de 1 a 4"):
        pipeline.Options(max_level=level)


def test_files_of_one_task_are_read_by_all(spark):
    """A table of one row group comes in one partition; its files are dealt out before they are parsed."""
    files = spark.createDataFrame([(i, "a", ".html", f"<p>x{i}</p>".encode()) for i in range(400)], "doc_id long, name string, suffix string, content binary").coalesce(1)
    found = read.paragraphs(files).select("doc_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(400))
    assert len({r["task"] for r in found}) == 4


def test_white_space_between_blocks_is_no_paragraph(monkeypatch):
    """Neither runs nor lines of a signature are made of it."""
    from docblocks.readers import html

    seen = []
    monkeypatch.setattr(html.PageReader, "runs", lambda self, nodes, outer=None, runs=html.PageReader.runs: seen.append(nodes) or runs(self, nodes, outer))
    page = "<div>\n <p>a <b>b</b></p>\n \xa0\n<p> c\t<i>d </i> e<br> f</p>\n</div>\n"
    assert ["".join(r.text for r in p.runs) for p in html.paragraphs(page)] == ["a b", "c d e\nf"]
    assert len(seen) == 2


def test_one_exchange_of_paragraphs(spark):
    """What is exchanged is paragraphs by document, the warnings, and the narrow sides of the last joins."""
    files = spark.createDataFrame([(i, f"n{i}.md", ".md", bytearray(b"1. A\n\nb")) for i in range(8)], "doc_id long, name string, suffix string, content binary").repartition(2)
    html = pipeline.documents(read.paragraphs(files))
    plan = html._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert html.where(F.col("html").contains("Item_Nivel1")).count() == 8


def test_plain_text_is_one_run_however_long():
    """A run for every stretch of one format, not one for every character."""
    assert [r.text for r in inline.runs("palavra " * 500)] == ["palavra " * 500]
    assert [(r.text, r.href, r.bold) for r in inline.runs("a b [c](u)[d](v) \\* **e f**")] == [("a b ", None, False), ("c", "u", False), ("d", "v", False), (" * ", None, False), ("e f", None, True)]

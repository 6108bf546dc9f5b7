"""Fixed values of the document model: class catalogue, thresholds and markers."""

from __future__ import annotations

#: Paragraph classes that the target editor knows (fixed values).
CLASSES = [
    "Citação", "Fonte_Calibri", "Item_Alinea_Letra", "Item_Inciso_Romano", "Item_Nivel1", "Item_Nivel2", "Item_Nivel3", "Item_Nivel4",
    "Paragrafo_Numerado_Nivel1", "Paragrafo_Numerado_Nivel2", "Paragrafo_Numerado_Nivel3", "Tabela_Texto_10", "Tabela_Texto_8",
    "Tabela_Texto_Alinhado_Direita", "Tabela_Texto_Alinhado_Esquerda", "Tabela_Texto_Centralizado", "Tachado", "Texto_Alinhado_Direita",
    "Texto_Alinhado_Esquerda", "Texto_Alinhado_Esquerda_Espacamento_Simples_Maiusc", "Texto_Alinhado_Esquerda_Espaçamento_Simples",
    "Texto_Centralizado", "Texto_Centralizado_Maiusculas", "Texto_Centralizado_Maiusculas_Negrito", "Texto_Citação", "Texto_Ementa",
    "Texto_Espaco_Duplo_Recuo_Primeira_Linha", "Texto_Fundo_Cinza_Maiusculas_Negrito", "Texto_Fundo_Cinza_Negrito", "Texto_Justificado",
    "Texto_Justificado_Maiusculas", "Texto_Justificado_Recuo_Primeira_Linha", "Texto_Justificado_Recuo_Primeira_Linha2", "Texto_Mono_Espaçado",
]

#: Suffixes that can be read, and those that were retired and only get guidance (fixed values).
SUPPORTED = [".docx", ".pdf", ".md", ".txt", ".odt", ".html", ".htm"]
RETIRED = [".rtf", ".doc"]
#: Schemes that a link may have (fixed values).
SCHEMES = ["http", "https", "mailto", "tel", "ftp"]

EXCERPT_WORDS = 12
TITLE_WORDS = 8
SENTENCE_WORDS = 5
CAPS_LETTERS = 3
QUOTE_LETTERS = 100
QUOTE_INDENT_CM = 2.0
SIGNATURE_WORDS = 12
SIGNATURE_LINES = 2
LINES_AFTER_MARK = 4
HEADING_CHARS = 60
TABLE_CHARS = 110
CELL_SLACK = 2
LEAST_COLUMN_PCT = 5.0
CELL_8_PT = 8.0
CELL_10_PT = 10.0
PAGE_PIXELS = 800
INHERITANCE_DEPTH = 10
#: Styles of an ODF chain that are looked at, the first one included, and points in a centimetre.
STYLE_LINKS, POINTS_PER_CM = 10, 72 / 2.54
REPEATED_COLUMNS = 32
REPEATED_ROWS = 200
WATCH_SECONDS = 2.0

OUTPUT_TITLE = "Conteúdo formatado para o SEI"
SIGNATURE_MARK = "<em>[Assinado eletronicamente]</em>"
#: Opening and closing quotation marks (fixed values).
QUOTES = {'"': '"', "“": "”", "«": "»"}
#: Roman numerals by value, largest first.
ROMANS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
#: Centimetres of a unit of length.
UNIT_CM = {"cm": 1.0, "mm": 0.1, "in": 2.54, "pt": 2.54 / 72, "pc": 2.54 / 6}

#: Colour of red passages.
RED = "C00000"
#: Least and greatest per cent of the text area that a table takes.
TABLE_WIDTHS = (10, 100)
TWIPS_PER_CM = 1440 / 2.54
EMU_PER_TWIP = 635
FIRST_LINE_PT = 8.0

#: A converted document.
RESULTS = "doc_id string, nome_origem string, sucesso boolean, erros array<string>, avisos array<string>, arquivos array<struct<nome:string,conteudo:string>>, citacoes_por_recuo int, citacoes_entre_aspas int, citacoes_trechos array<string>, cabecalho_paragrafos int, cabecalho_trechos array<string>"

# What the platform writes into documents (fixed values): notes and how they end, the footer of a page, and the kinds of documents
# whose name and number extraction leaves behind, without accents.
NOTE_CODE = r"c[oó]digo\s+CRC\s+[0-9A-F]+\.?"
NOTES = (("Documento assinado eletronicamente por", r"Decreto\s+n[º°]\s*10\.543[^\n]*\."), ("A autenticidade do documento pode ser conferida", r"informando[^\n]*\."))
FOOTER = r"SEI\s+[\d./_\-]+\s*/\s*pg\.\s*\d+"
ACCENTED, UNACCENTED = "áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ", "aaaaeeiooouucAAAAEEIOOOUUC"
DOCUMENT_TYPES = "despacho; nota tecnica; oficio; parecer; memorando; portaria; informacao; relatorio; edital; ata; termo de referencia; decisao; instrucao normativa; comunicacao interna; circular; resolucao; certidao; declaracao; manifestacao".split("; ")
#: Style of a paragraph whose number is part of its text (an own name: nothing reads it but this engine).
LITERAL_NUMBER = "Numero_Literal"

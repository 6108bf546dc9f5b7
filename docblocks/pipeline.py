"""Conversion of documents: files of any known format to classed blocks, whole HTML pages and results, in one plan.

Files are read in one pass (``readers.read``). Their paragraphs are grouped by document once: folds
over each document's array find signatures and quotations, aggregates decide its numbering
convention, base level and body font. From there on, rows stay where they are: the class ladder is
one CASE, lists, tables and signatures are windows and aggregates over keys that begin with the
document, so the plan has one exchange of paragraphs.

A document that can't be read is a result with an error, and so is one without content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import text as T
from docblocks.lineage import cut
from docblocks.operators import markdown as M
from docblocks.operators import ordered as O
from docblocks.operators import render, rules, tables, validate
from docblocks.readers import read
from docblocks.readers.model import FIELDS

# Messages (fixed values).
NOTHING = "Nenhum conteúdo extraído de %s."
BAD_LEVEL = "use um número de 1 a 4 (recebido: %s)"
SIGNATURE = "Tabela_Texto_Centralizado"
#: Classes with which a document's body begins.
BODY_STARTS = ("Item_Nivel1", "Paragrafo_Numerado_Nivel1")
#: Formats of numbered lists that are no items of their own (fixed values).
NO_ITEMS = ("bullet", "lowerLetter", "upperRoman", "lowerRoman")


@dataclass(frozen=True)
class Options:
    """What a conversion may ask for."""

    max_level: int = 4
    quotes: bool = False
    skip_header: bool = False
    body_only: bool = False
    validate: bool = True

    def __post_init__(self) -> None:
        if self.max_level not in (1, 2, 3, 4):
            raise ValueError(BAD_LEVEL % self.max_level)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _keep(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows`` where the condition holds, tested on columns as they are computed.

    A plain filter would be pushed below the columns that it names, with their whole definitions
    written out once more for every use; a column that isn't deterministic stops that.
    """
    return rows.withColumn("kept_at", F.monotonically_increasing_id()).where((F.col("kept_at") >= 0) & condition).drop("kept_at")


def prepared(paragraphs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Paragraphs with content and what their text alone says: text, depth of a typed number, flags of the document's rules.

    Cells stay even without content; an empty paragraph is no block.
    """
    rows = paragraphs.where("kind not in ('warning', 'error')").withColumn("text", T.runs_text(F.col("runs")))
    has_image = F.exists("runs", lambda r: r["image"].isNotNull())
    rows = rows.where((F.col("kind") == "cell") | (T.strip(F.col("text")) != "") | has_image)
    named = F.coalesce(F.col("explicit"), rules.class_from_style(F.col("style")))
    cell = F.col("kind") == "cell"
    named = F.when(~cell | named.startswith("Tabela_"), named)
    body = F.col("kind") == "p"
    free = body & named.isNull() & ~_flag(F.col("literal"))
    rows = rows.withColumn("named", named).withColumn("depth", F.when(free, T.item_depth(F.col("text"))).otherwise(0))
    heading = F.coalesce(F.col("style"), F.lit("")).rlike(r"(?i)(heading|t[ií]tulo)\s*\d")
    item = body & (F.col("depth") == 0) & F.col("num_format").isNotNull()
    opener = body & named.isNull() & ~heading & ((F.col("depth") == 1) | (item & ~F.col("num_format").isin(*NO_ITEMS) & (F.coalesce("level", F.lit(0)) == 0)))
    bare = T.strip(F.col("text"))
    short = F.size(T.words(bare)).between(1, S.SIGNATURE_WORDS)
    plain = body & named.isNull() & (F.col("depth") == 0) & ~heading & F.col("num_format").isNull()
    first = F.regexp_extract(F.lower(F.coalesce("style", F.lit(""))), r"(?:heading|t[ií]tulo)\s*(\d)", 1)
    return rows.withColumns(
        {
            "opener": opener,
            "prose": F.when(opener, T.is_prose(F.col("text"))),
            "short": F.when(plain & short, bare),
            "quotable": F.when(body & ~_flag(F.col("breaks")), F.col("text")),
            "starts": F.when(F.col("named").isNotNull(), F.col("named") == "Item_Nivel1").otherwise(body & (first == "1")),
            "chars": F.when(body & F.col("size").isNotNull(), F.length("text")),
        }
    )


def judged(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Paragraphs with what their document says: convention, base level, body font, signature and quotation."""
    columns = [c for c in rows.columns if c not in (id_col, "pos")]
    whole = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("x"))
    x = F.col("x")
    votes = F.aggregate(x, F.lit(0), lambda a, r: a + F.when(_flag(r["opener"]), F.when(r["prose"], 1).otherwise(-1)).otherwise(0))
    convention = F.when(votes > 0, "paragrafos").otherwise("titulos")
    # the size with the most characters; on ties the one met first
    known = F.filter(x, lambda r: r["chars"] > 0)
    total = lambda s: F.aggregate(F.filter("known", lambda r: r["size"] == s), F.lit(0).cast("bigint"), lambda a, r: a + r["chars"])
    # what is used more than once is a column, so that it is computed once
    whole = whole.withColumns({"convention": convention, "flags": F.transform(x, lambda r: r["short"].isNotNull() & _flag(r["align"] == "center")), "shorts": F.col("x.short"), "known": F.transform(known, lambda r: F.struct(r["size"].alias("size"), r["chars"].alias("chars")))})
    whole = whole.withColumns({"tail": O.signature_tail(F.col("flags"), F.col("shorts")), "sizes": F.array_distinct("known.size")})
    titled = F.exists(x, lambda r: _flag(r["starts"])) | ((F.col("convention") == "titulos") & F.exists(x, lambda r: r["depth"] == 1))
    best = F.array_max(F.transform("sizes", lambda s, i: F.struct(total(s).alias("w"), (-i).alias("i"), s.alias("s"))))["s"]
    signed = M.signature_indices(F.col("flags"), F.col("shorts"), F.col("tail"))
    whole = whole.select(id_col, "x", "convention", F.when(titled, 2).otherwise(1).alias("base"), signed.alias("signed_at"), O.quoted_spans(F.col("x.quotable")).alias("quoted_at"), best.alias("body_size"))
    n = F.size("x")
    signed_flags = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains("signed_at", i))
    quoted_flags = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains("quoted_at", i))
    zipped = F.arrays_zip(x.alias("r"), signed_flags.alias("s"), quoted_flags.alias("q"))
    out = whole.select(id_col, "convention", "base", "body_size", F.explode(zipped).alias("z"))
    return out.select(id_col, "z.r.*", F.col("z.s").alias("signed"), F.col("z.q").alias("quoted"), "convention", "base", "body_size")


def classed(rows: DataFrame, options: Options) -> DataFrame:
    """Paragraphs with ``class`` and ``html`` (of the paragraph or list item); separators and what numbers leave empty go."""
    cell, first_row = F.col("kind") == "cell", F.coalesce(F.col("row"), F.lit(0)) == 0
    align, text, named = F.col("align"), F.col("text"), F.col("named")
    # each step adds columns, and the next one names them: nothing is computed or planned twice
    rows = rows.withColumns(
        {
            "all_caps": T.is_caps(text),
            "indented": rules.is_indented_quote(F.col("indent_cm"), F.col("size"), F.col("body_size"), align),
            "by_quotes": ~cell & F.col("quoted") & ~_flag(align.isin("center", "right")) & named.isNull() & ~F.col("signed"),
            "format": F.when(F.col("kind") == "bullet", "bullet").otherwise(F.col("num_format")),
            "style_name": F.coalesce("named", "style"),
        }
    )
    rows = rows.withColumn("by_format", rules.class_from_format(F.col("strike"), F.col("grey"), F.col("spaced"), F.col("bold"), align, _flag(F.col("caps")) | F.col("all_caps")))
    ladder = rules.paragraph_class(
        F.col("style_name"), F.col("depth"), F.col("convention"), F.col("format"), F.coalesce("level", F.lit(0)), F.col("base"), F.col("by_format"),
        F.col("by_quotes") & F.lit(options.quotes), F.col("signed"), F.col("indented") & F.lit(options.quotes) & ~F.col("quoted"), align, F.col("first_pt"), options.max_level, named,
    )
    rows = rows.withColumn("class", F.when(cell, F.coalesce(named, rules.class_from_cell(F.col("size"), align, first_row))).otherwise(ladder))
    free = F.col("class").isin("Citação", "Texto_Justificado", "Texto_Alinhado_Esquerda", "Texto_Justificado_Recuo_Primeira_Linha")
    rows = rows.withColumn("by_indent", ~cell & named.isNull() & (F.col("depth") == 0) & ~F.col("signed") & ~F.col("quoted") & F.col("indented") & free)
    code = F.col("class") == "Texto_Mono_Espaçado"
    rows = _keep(rows, cell | code | ~T.strip(text).rlike(r"^[-–—]{3,}$"))
    as_quote = F.col("by_quotes") & (F.col("class") == "Citação")
    depth = F.when(as_quote, 0).otherwise(F.col("depth"))
    family = F.when(cell | as_quote | _flag(F.col("literal")), F.lit("")).otherwise(F.coalesce(T.number_family(F.col("class"), depth), F.lit("")))
    rows = rows.withColumn("family", family).withColumn("skip", F.length(T.number_prefix(text, F.col("family"))))
    rows = rows.withColumn("shown", T.runs_from(F.col("runs"), F.col("skip")))
    rows = rows.withColumn("shown", F.when(F.col("class") == "Tachado", F.transform("shown", lambda r: r.withField("strike", F.lit(False)))).otherwise(F.col("shown")))
    rows = rows.withColumn("html", T.runs_html(F.col("shown")))
    rows = rows.withColumn("html", F.when(code, F.regexp_replace("html", r"\s+$", "")).otherwise(M.link_residues(T.strip(F.col("html")))))
    rows = _keep(rows, cell | (T.strip(F.col("html")) != ""))
    html = F.col("html")
    rows = rows.withColumn("html", F.when(F.col("signed") & _flag(F.col("caps")) & ~F.col("all_caps"), T.upper_outside_tags(html)).otherwise(html))
    strong = ((cell & first_row) | (F.col("signed") & _flag(F.col("bold")))) & (html != "") & ~F.contains(html, F.lit("<strong>"))
    rows = rows.withColumn("html", F.when(strong, F.concat(F.lit("<strong>"), html, F.lit("</strong>"))).otherwise(html))
    item = F.concat(F.lit('<li class="Texto_Justificado">'), html, F.lit("</li>"))
    return rows.withColumn("html", F.when(F.col("class") == "marcador", item).when(html != "", render.block(F.col("class"), html)).otherwise(""))


def blocks(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, class, html, text): one row for each paragraph, list and table, in order; signatures set apart."""
    kind = F.when(F.col("kind") == "cell", "cell").when(F.col("class") == "marcador", "list").otherwise("p")
    rows = rows.withColumn("unit_kind", kind)
    doc = Window.partitionBy(id_col).orderBy("pos")
    key = F.concat_ws(":", "unit_kind", F.col("table_no").cast("string"))
    opens = (F.col("unit_kind") == "p") | F.coalesce(key != F.lag(key).over(doc), F.lit(True))
    rows = rows.withColumn("opens", F.when(opens, F.col("pos"))).withColumn("unit", F.last("opens", True).over(doc.rowsBetween(Window.unboundedPreceding, 0)))

    # paragraphs of a cell, then its place in the grid and how many rows it spans
    one = F.col("unit_kind") != "cell"
    spot = rows.withColumns({"r": F.when(one, 0).otherwise(F.col("row")), "c": F.when(one, F.col("pos")).otherwise(F.col("cell"))})
    cells = spot.groupBy(id_col, "unit", "r", "c").agg(
        F.min("unit_kind").alias("unit_kind"), F.min_by("class", "pos").alias("class"), F.max("level").alias("level"), F.max("span").alias("span"), F.bool_or("continues").alias("continues"),
        F.max("grid").alias("grid"), F.bool_or("fixed_grid").alias("fixed"), F.max("table_width").alias("table_width"),
        F.sort_array(F.collect_list(F.struct("pos", "html", "text"))).alias("x"),
    )
    row = Window.partitionBy(id_col, "unit", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("gridcol", F.when(F.col("unit_kind") == "cell", F.coalesce(F.sum("span").over(row), F.lit(0))).cast("int"))
    inner = F.array_join(F.transform(F.filter("x", lambda p: p["html"] != ""), lambda p: p["html"]), "\n")
    cells = cells.withColumns({"inner": inner, "text": F.array_join(F.col("x.text"), "\n")})
    column = Window.partitionBy(id_col, "unit", "gridcol").orderBy("r")
    goes_on = _flag(F.col("continues"))
    nth = F.sum((~goes_on).cast("int")).over(column.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("nth", nth).withColumn("rowspan", F.count("*").over(Window.partitionBy(id_col, "unit", "gridcol", "nth")).cast("int"))
    cells = cells.where((F.col("unit_kind") != "cell") | ~goes_on)

    # tables: widths from the grid, or from the content where nobody chose them; then rows, then the whole
    need, want = tables.cell_measures(F.when(F.col("span") == 1, F.col("text")).otherwise(""))
    col = F.struct("gridcol", need.alias("n"), want.alias("w"), (F.col("span") == 1).alias("one"))
    filled = F.when(F.col("inner") == "", F.lit(f'<p class="{SIGNATURE}">&nbsp;</p>')).otherwise(F.col("inner"))
    cell = F.struct("r", "c", "gridcol", "span", "rowspan", filled.alias("html"))
    units = cells.groupBy(id_col, "unit").agg(
        F.min("unit_kind").alias("unit_kind"), F.min_by("class", F.struct("r", "c")).alias("class"), F.max("grid").alias("grid"), F.bool_or("fixed").alias("fixed"), F.max("table_width").alias("table_width"),
        F.sort_array(F.collect_list(cell)).alias("cells"), F.collect_set(F.when(F.col("unit_kind") == "cell", col)).alias("cols"),
        F.sort_array(F.collect_list(F.struct("c", F.coalesce("level", F.lit(0)).alias("level"), F.col("inner").alias("html")))).alias("items"), F.min_by("text", F.struct("r", "c")).alias("text"),
    )
    least = F.lit(float(1 + S.CELL_SLACK))
    widest = lambda field: F.transform(F.sequence(F.lit(0), F.size("grid") - 1), lambda k: F.coalesce(F.array_max(F.transform(F.filter("cols", lambda c: (c["gridcol"] == k) & c["one"]), lambda c: c[field])), least))
    even = tables.equal_columns(F.col("grid")) & ~_flag(F.col("fixed"))
    is_table = F.col("unit_kind") == "cell"
    widths = F.when(is_table & even, tables.content_shares(widest("n"), widest("w"))).otherwise(F.col("grid"))
    units = units.withColumn("widths", widths)
    html = F.when(is_table, _table_html()).when(F.col("unit_kind") == "list", O.list_html(F.col("items"))).otherwise(F.get("items", F.lit(0))["html"])
    found = units.select(id_col, F.col("unit").alias("pos"), F.when(F.col("unit_kind") == "p", F.col("class")).alias("class"), html.alias("html"), "text")
    return signatures(found, id_col)


def _table_html() -> Column:
    """A table from its cells (sorted by row and cell), ``widths`` and ``table_width``; widths stand in the first row only."""

    def cell(x: Column) -> Column:
        width = F.bround(F.aggregate(F.slice("widths", x["gridcol"] + 1, F.greatest(x["span"], F.lit(1))), F.lit(0.0), lambda a, w: a + w), 1)
        attrs = F.array_compact(
            F.array(
                F.when((x["r"] == 0) & (width > 0), F.concat(F.lit('width="'), width.cast("string"), F.lit('%"'))),
                F.when(x["span"] > 1, F.concat(F.lit('colspan="'), x["span"].cast("string"), F.lit('"'))),
                F.when(x["rowspan"] > 1, F.concat(F.lit('rowspan="'), x["rowspan"].cast("string"), F.lit('"'))),
                F.when(x["r"] == 0, F.lit('style="vertical-align:middle; background-color:#e6e6e6;"')).otherwise(F.lit('style="vertical-align:middle;"')),
            )
        )
        return F.concat(F.lit("      <td "), F.array_join(attrs, " "), F.lit(">\n"), x["html"], F.lit("\n      </td>"))

    numbers = F.array_sort(F.array_distinct(F.col("cells.r")))
    lines = F.transform(numbers, lambda r: F.concat(F.lit("    <tr>\n"), F.array_join(F.transform(F.filter("cells", lambda x: x["r"] == r), cell), "\n"), F.lit("\n    </tr>")))
    opening = F.concat(F.lit('<table align="center" border="1" cellpadding="1" cellspacing="1" width="'), F.coalesce("table_width", F.lit(100)).cast("string"), F.lit('%">\n  <tbody>\n'))
    return F.concat(opening, F.array_join(lines, "\n"), F.lit("\n  </tbody>\n</table>"))


def signatures(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks whose signature marks read alike, with a blank line before every mark but the first of its run."""
    signed = F.coalesce(F.col("class") == SIGNATURE, F.lit(False))
    marked = O.runs(found.withColumn("signed", signed), id_col, "pos", "signed").withColumn("mark", F.col("signed") & T.is_signature_mark(T.strip(F.col("text"))))
    nth = F.sum(F.col("mark").cast("int")).over(Window.partitionBy(id_col, "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    blank = f'<p class="{SIGNATURE}">&nbsp;</p>'
    before = F.lag("html").over(Window.partitionBy(id_col).orderBy("pos"))
    line = F.lit(f'<p class="{SIGNATURE}">{S.SIGNATURE_MARK}</p>')
    again = (nth > 1) & (F.coalesce(before, F.lit("")) != blank)
    html = F.when(F.col("mark"), F.when(again, F.concat(F.lit(blank + "\n"), line)).otherwise(line)).otherwise(F.col("html"))
    return marked.select(id_col, "pos", "class", html.alias("html"), "text")


def convert(files: DataFrame, options: Options = Options(), id_col: str = "doc_id", name_col: str = "name", suffix_col: str = "suffix", content_col: str = "content", recognised_col: str | None = None, pasted: bool = False, css: str = "") -> DataFrame:
    """Results (S.RESULTS) of files: success, errors, warnings, the file written for each, what was found."""
    # parsed once, classed once: what follows reads the two tables, and its plan has neither parser nor ladder in it
    paragraphs = cut(read.paragraphs(files, id_col, name_col, suffix_col, content_col, recognised_col, pasted))
    said = paragraphs.where("kind in ('warning', 'error')").groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "warning", F.struct("pos", "message")))).alias("w"), F.sort_array(F.collect_list(F.when(F.col("kind") == "error", F.struct("pos", "message")))).alias("e")
    )
    rows = cut(classed(judged(prepared(paragraphs, id_col), id_col), options))
    quote = F.col("by_quotes") | F.col("by_indent")
    quotes = rows.groupBy(id_col).agg(F.count_if("by_indent").cast("int").alias("n_indent"), F.count_if("by_quotes").cast("int").alias("n_quotes"), F.sort_array(F.collect_list(F.when(quote, F.struct("pos", T.excerpt(F.col("text")).alias("t"))))).alias("q"))
    found = blocks(rows, id_col)
    starts = F.col("class").isin(*BODY_STARTS)
    found = O.split_header(found, id_col, "pos", starts)
    shown = T.block_excerpt(F.col("html"))
    body = F.struct("pos", "html")
    joined = found.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.when(~F.col("header") | F.lit(not options.skip_header), body))).alias("b"),
        F.count_if("header").cast("int").alias("n_header"),
        F.sort_array(F.collect_list(F.when(F.col("header") & (T.strip(F.replace(shown, F.lit(" "), F.lit(" "))) != ""), F.struct("pos", shown.alias("t"))))).alias("h"),
    )
    named = files.select(F.col(id_col), F.col(name_col).alias("nome_origem"), F.lower(F.col(suffix_col)).alias("suffix_"))
    out = named.join(said, id_col, "left").join(joined, id_col, "left").join(quotes, id_col, "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("corpo", F.array_join(F.col("b.html"), "\n"))
    errors = F.when(F.size("e") > 0, F.col("e.message")).when(F.coalesce(F.size("b"), F.lit(0)) <= 0, F.array(F.format_string(NOTHING, "nome_origem"))).otherwise(none)
    out = out.withColumn("erros", errors).withColumn("sucesso", F.size("erros") == 0)
    page = F.concat("corpo", F.lit("\n")) if options.body_only else render.html_document(F.col("corpo"), css)
    written = F.array(F.struct(T.output_name(F.col("nome_origem"), options.body_only).alias("nome"), page.alias("conteudo")))
    empty = F.array().cast("array<struct<nome:string,conteudo:string>>")
    out = out.withColumn("arquivos", F.when(F.col("sucesso"), written).otherwise(empty))
    checked = validate.messages(F.col("corpo"), F.col("suffix_") == ".md") if options.validate else none
    out = out.withColumn("checked", checked)
    ok = F.col("sucesso")
    return out.select(
        id_col,
        "nome_origem",
        "sucesso",
        "erros",
        F.when(ok, F.concat(F.coalesce(F.col("w.message"), none), F.coalesce("checked", none))).otherwise(none).alias("avisos"),
        "arquivos",
        F.when(ok, F.coalesce("n_indent", F.lit(0))).otherwise(0).alias("citacoes_por_recuo"),
        F.when(ok, F.coalesce("n_quotes", F.lit(0))).otherwise(0).alias("citacoes_entre_aspas"),
        F.when(ok, F.coalesce(F.col("q.t"), none)).otherwise(none).alias("citacoes_trechos"),
        F.when(ok, F.coalesce("n_header", F.lit(0))).otherwise(0).alias("cabecalho_paragrafos"),
        F.when(ok, F.coalesce(F.col("h.t"), none)).otherwise(none).alias("cabecalho_trechos"),
    )


def convert_bytes(spark: SparkSession, name: str, content: bytes, options: Options = Options(), recognised: str | None = None, pasted: bool = False) -> dict:
    """One file's result as a dictionary: the conversion of a table of one row."""
    suffix = f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else ""
    files = spark.createDataFrame([(0, name, suffix, bytearray(content), recognised)], "doc_id long, name string, suffix string, content binary, recognised string")
    row = convert(files, options, recognised_col="recognised" if recognised is not None else None, pasted=pasted).first()
    return row.asDict(recursive=True)


def documents(paragraphs: DataFrame, options: Options = Options(), id_col: str = "doc_id") -> DataFrame:
    """(id, html): the body of every document of a table of paragraphs."""
    return render.joined_blocks(blocks(classed(judged(prepared(paragraphs, id_col), id_col), options), id_col), id_col, "pos", "html")


__all__ = ["FIELDS", "Options", "blocks", "classed", "convert", "convert_bytes", "documents", "judged", "prepared", "signatures"]

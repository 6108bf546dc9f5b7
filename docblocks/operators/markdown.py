"""Markdown and plain text lines to typed blocks: a ladder of rules per line, islands for what spans lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import text as T
from docblocks.operators import ordered as O


def line_kind(line: Column, markdown: bool = True) -> Column:
    """Kind of a line outside code blocks and red regions; the first rule that holds wins."""
    separator = r"^\s*([-–—*_~])(?:\s*\1){2,}\s*$" if markdown else r"^\s*([-–—*_])(?:\s*\1){2,}\s*$"
    kind = F.when(T.strip(line) == "", "blank").when(line.rlike(separator), "separator").when(line.rlike(r"(?is)^<p\s+class=[\"'][^\"']+[\"']>.*</p>$"), "classed")
    if markdown:
        kind = kind.when(line.rlike(r"^>\s?"), "quote").when(T.is_struck(line), "struck").when(line.rlike(r"^#{1,6}\s+\S"), "heading")
    return kind.when(line.rlike(r"^\s*[-*+]\s+\S"), "bullet").when(line.rlike(r"^\s*\|.*\|\s*$"), "table").otherwise("paragraph")


def heading(line: Column) -> tuple[Column, Column]:
    """(level up to 4, text) of a heading line."""
    return F.least(F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)), F.lit(4)), T.strip(F.regexp_replace(line, r"^#{1,6}\s+", ""))


def bullet(line: Column) -> tuple[Column, Column]:
    """(level 0 to 3, text) of a list line; task boxes become words."""
    indent = F.length(F.regexp_extract(line, r"^(\s*)", 1))
    body = F.regexp_replace(line, r"^\s*[-*+]\s+", "")
    body = F.regexp_replace(F.regexp_replace(body, r"^\[[xX]\]\s+", "Concluído: "), r"^\[ \]\s+", "Pendente: ")
    return F.least(F.floor((indent + 1) / 2).cast("int"), F.lit(3)), body


def quote_text(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:>\s?)+", "")


def blocks(lines: DataFrame, id_col: str, pos: str, line: str, markdown: bool = True) -> DataFrame:
    """(id, pos, kind, level, text): lines with their kinds; lines of code blocks are ``code`` whatever they look like."""
    text = F.col(line)
    if markdown:
        listed = lines.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(pos, line))).alias("__l"))
        flags = listed.select(id_col, F.explode(F.arrays_zip(F.col(f"__l.{pos}").alias("p"), F.col(f"__l.{line}").alias("t"), O.fence_blocks(F.col(f"__l.{line}")).alias("c"))).alias("z"))
        lines = flags.select(id_col, F.col("z.p").alias(pos), F.col("z.t").alias(line), F.col("z.c").alias("__code"))
    else:
        lines = lines.withColumn("__code", F.lit(False))
    fence = F.col("__code") & text.rlike(r"^`{3,}")
    kind = F.when(fence, "fence").when(F.col("__code"), "code").otherwise(line_kind(text, markdown))
    rows = lines.withColumn("kind", kind).where("kind not in ('blank', 'separator', 'fence')")
    k = F.col("kind")
    h, b = heading(text), bullet(text)
    level = F.when(k == "heading", h[0]).when(k == "bullet", b[0])
    body = F.when(k == "heading", h[1]).when(k == "bullet", b[1]).when(k == "quote", quote_text(text)).when(k == "struck", F.replace(text, F.lit("~~"), F.lit(""))).when(k == "classed", T.class_line(text)[1]).otherwise(text)
    return rows.select(id_col, pos, "kind", level.alias("level"), body.alias("text"))


def pipe_tables(lines: DataFrame, id_col: str, pos: str, line: str) -> DataFrame:
    """(id, table, row, cells): neighbouring lines of pipes as tables; rows of dashes go, escaped pipes stay."""
    w = Window.partitionBy(id_col).orderBy(pos)
    marked = lines.withColumn("__t", F.col(line).rlike(r"^\s*\|.*\|\s*$"))
    island = F.col(pos) - F.sum(F.col("__t").cast("int")).over(w)
    rows = marked.withColumn("__g", island).where("__t").withColumn("table", F.min(pos).over(Window.partitionBy(id_col, "__g")))
    inner = F.regexp_replace(F.regexp_replace(F.col(line), r"^\s*\|", ""), r"\|\s*$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(T.strip(c), F.lit("\\|"), F.lit("|")))
    rows = rows.withColumn("cells", cells).where(~F.forall("cells", lambda c: c.rlike(r"^:?-+:?$")))
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(id_col, "table").orderBy(pos)) - 1).select(id_col, "table", "row", "cells")


def red_regions(lines: DataFrame, id_col: str, pos: str, line: str) -> DataFrame:
    """``lines`` with ``red``: true from a line that opens a red region to the one that closes it."""
    w = Window.partitionBy(id_col).orderBy(pos)
    opens = F.size(F.split(line, "<red>")) - 1
    closes = F.size(F.split(line, "</red>")) - 1
    before = F.coalesce(F.sum(opens - closes).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("red", (before > 0) | (opens > 0))


def link_residues(html: Column) -> Column:
    """Markdown links left in text outside tags and anchors, as anchors; unsafe addresses stay text."""
    tokens = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s.*?</a>|<[^>]*>|[^<]+|<)"), F.lit(1))
    link = r"\[([^\]]+)\]\((https?://(?:[^()\s]|\([^()\s]*\))+)\)"
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("<"), t).otherwise(F.regexp_replace(t, link, '<a href="$2">$1</a>'))), "")


#: What stands for an image, and for one without a description (fixed values).
NO_IMAGE, NO_DESCRIPTION = "Imagem não incorporada (%s)", "sem descrição"


def image_placeholders(line: Column) -> Column:
    """Images as words: their description, its marks escaped, or that there was none."""
    image = r"!\[[^\]]*\]\([^)]+\)"
    pieces = F.regexp_extract_all(line, F.lit(rf"(?s)({image}|[^!]+|!)"), F.lit(1))

    def shown(piece: Column) -> Column:
        label = T.strip(F.regexp_extract(piece, r"(?s)^!\[([^\]]*)\]", 1))
        words = T.escape_markdown(F.when(label == "", NO_DESCRIPTION).otherwise(label))
        return F.when(piece.rlike(rf"(?s)^{image}$"), F.format_string(NO_IMAGE, words)).otherwise(piece)

    return F.array_join(F.transform(pieces, shown), "")


def signature_lines(text: Column) -> Column:
    """A paragraph with breaks as lines from its signature mark on, after what stands before.

    One without a mark stays as it is, and so does one in which a line after the mark is too long for a name or an office.
    """
    none = F.array().cast("array<string>")

    def from_mark(lines: Column, at: Column) -> Column:
        rest = F.filter(F.slice(lines, at, F.size(lines)), lambda x: x["seen"] != "")
        head = T.strip(F.array_join(F.slice(lines, 1, at - 1)["part"], "\n"))
        parts = lambda r: F.concat(T.let(head, lambda h: F.when(h != "", F.array(h)).otherwise(none)), r["part"])
        short = lambda r: F.forall(r, lambda x: F.size(T.words(x["seen"])) <= S.SIGNATURE_WORDS)
        return T.let(rest, lambda r: F.when(~short(r), F.array(text)).otherwise(parts(r)))

    lines = F.transform(F.split(text, "\n"), lambda line: T.let(T.strip(line), lambda part: F.struct(part.alias("part"), T.unescape_markdown(part).alias("seen"))))
    marked = lambda x: F.array_position(F.transform(x, lambda line: T.is_signature_mark(line["seen"])), F.lit(True)).cast("int")
    return T.let(lines, lambda x: T.let(marked(x), lambda at: F.when(at == 0, F.array(text)).otherwise(from_mark(x, at))))


def signature_indices(flags: Column, short: Column, tail: Column | None = None) -> Column:
    """Positions (from 0) of all signature lines: the block at the end, and blocks inside that start at a mark.

    Inside, a centred mark goes on over flagged lines, another over at most four short lines that
    don't end like sentences; two lines are the least, and a block that touches the end is the end's.
    ``tail`` is ``signature_tail`` of the same arrays; a column of its own keeps it from being computed for every line.
    """
    total = F.size(flags)
    tail = O.signature_tail(flags, short) if tail is None else tail
    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("i"), empty.alias("open"), F.lit(False).alias("centred"), empty.alias("out"))
    both = F.arrays_zip(flags.alias("f"), short.alias("s"))

    def step(acc: Column, x: Column) -> Column:
        flag, text = F.coalesce(x["f"], F.lit(False)), x["s"]
        mark = T.is_signature_mark(text)
        going = F.size(acc["open"]) > 0
        plain = text.isNotNull() & ~mark & ~F.coalesce(text.rlike(r"[.,:;]$"), F.lit(False)) & (F.size(acc["open"]) <= S.LINES_AFTER_MARK)
        more = going & F.when(acc["centred"], flag).otherwise(F.coalesce(plain, F.lit(False)))
        opens = ~more & mark
        ended = F.when(going & ~more & (F.size(acc["open"]) >= S.SIGNATURE_LINES), acc["open"]).otherwise(empty)
        mine = F.when(more, F.concat(acc["open"], F.array(acc["i"]))).when(opens & (acc["i"] < total - tail), F.array(acc["i"])).otherwise(empty)
        return F.struct((acc["i"] + 1).cast("int").alias("i"), mine.alias("open"), F.when(more, acc["centred"]).otherwise(flag).alias("centred"), F.concat(acc["out"], ended).alias("out"))

    inside = F.aggregate(both, start, step, lambda acc: acc["out"])
    at_end = F.when(tail > 0, F.sequence(total - tail, total - 1)).otherwise(empty)
    return F.array_sort(F.array_distinct(F.concat(inside, at_end)))


def structured(frame: DataFrame, id_col: str, pos: str, line: str) -> DataFrame:
    """(id, first, kind, level, text): regrouped text of a PDF as headings, centred header lines and paragraphs."""
    rows = O.regroup(frame, id_col, pos, line)
    text = F.col("text")
    number, rest = F.regexp_extract(text, r"^(\d{1,2}(?:\.\d{1,2})*)\.\s+\S.*$", 1), F.regexp_extract(text, r"^\d{1,2}(?:\.\d{1,2})*\.\s+(\S.*)$", 1)
    titled = (number != "") & T.is_caps_heading(rest)
    level = F.when(titled, F.least(F.size(F.split(number, r"\.")), F.lit(4))).when(T.is_caps_heading(text), 2)
    kind = F.when(F.col("kind") == "cabecalho", "centred").when(level.isNotNull(), "heading").otherwise("paragraph")
    return rows.select(id_col, "first", kind.alias("kind"), F.when(kind == "heading", level).alias("level"), "text")

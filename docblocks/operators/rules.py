"""Classification of paragraphs: ordered rules as one CASE, document votes as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import text as T


def class_from_style(name: Column) -> Column:
    """The catalogue class that a style's name is, spaces or underscores, else null."""
    under = F.replace(name, F.lit(" "), F.lit("_"))
    return F.when(name.isin(S.CLASSES), name).when(under.isin(S.CLASSES), under)


def class_from_format(strike: Column, grey: Column, spaced: Column, bold: Column, align: Column, caps: Column) -> Column:
    """Class that the appearance alone decides; unknown (null) parts never fire a rule."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    centred = yes((align == "center") & caps)
    return (
        F.when(yes(strike), "Tachado")
        .when(yes(grey & bold), F.when(yes(caps), "Texto_Fundo_Cinza_Maiusculas_Negrito").otherwise("Texto_Fundo_Cinza_Negrito"))
        .when(yes(spaced & bold), "Texto_Espaco_Duplo_Recuo_Primeira_Linha")
        .when(centred, F.when(yes(bold), "Texto_Centralizado_Maiusculas_Negrito").otherwise("Texto_Centralizado_Maiusculas"))
    )


def class_from_cell(size: Column, align: Column, first_row: Column) -> Column:
    """Class of a table cell: small fonts whose class has the cell's alignment, then the header row, then the alignment."""
    plain = align.isNull() | align.isin("left", "justify")
    centred = first_row | F.coalesce(align == "center", F.lit(False))
    return (
        F.when((size <= S.CELL_10_PT) & centred, "Tabela_Texto_10")
        .when((size <= S.CELL_8_PT) & plain, "Tabela_Texto_8")
        .when(centred, "Tabela_Texto_Centralizado")
        .when(align == "right", "Tabela_Texto_Alinhado_Direita")
        .otherwise("Tabela_Texto_Alinhado_Esquerda")
    )


def is_indented_quote(indent: Column, size: Column, body_size: Column, align: Column) -> Column:
    """Indented far enough and smaller than the body, and neither centred nor to the right."""
    return F.coalesce((indent >= S.QUOTE_INDENT_CM) & (size < body_size), F.lit(False)) & (align.isNull() | align.isin("left", "justify"))


def heading_level(style: Column) -> Column:
    level = F.regexp_extract(F.lower(style), r"^(?:heading|t[ií]tulo)\s+(\d)", 1)
    return F.when(level != "", F.least(level.cast("int"), F.lit(4)))


def paragraph_class(style: Column, depth: Column, convention: Column, num_format: Column, level: Column, base: Column, by_format: Column, quoted: Column, signed: Column, indent_quote: Column, align: Column, first_line_pt: Column, max_level: int = 4, named: Column | None = None) -> Column:
    """The full ladder for a body paragraph; the first rule that holds wins. ``named`` is the class that the style names, if it is known."""
    named = class_from_style(style) if named is None else named
    text = lambda x: x.cast("string")
    name = F.lower(F.coalesce(style, F.lit("")))
    deepest = max(1, min(4, max_level))
    counted = F.greatest(F.lit(1), F.least(F.lit(4), base + level))
    family = lambda n: F.when(convention == "paragrafos", F.concat(F.lit("Paragrafo_Numerado_Nivel"), text(F.least(n, F.lit(3))))).otherwise(F.concat(F.lit("Item_Nivel"), text(n)))
    no = F.lit(False)
    return (
        F.when(named.isNotNull(), named)
        .when(F.coalesce(signed, no), "Tabela_Texto_Centralizado")
        .when(F.coalesce(quoted, no) & ~F.coalesce(align, F.lit("")).isin("center", "right"), "Citação")
        .when((depth > 0) & (convention == "paragrafos"), F.when(depth <= 3, F.concat(F.lit("Paragrafo_Numerado_Nivel"), text(depth))).otherwise("Item_Alinea_Letra"))
        .when(depth > 0, F.when(depth <= deepest, F.concat(F.lit("Item_Nivel"), text(depth))).otherwise("Item_Alinea_Letra"))
        .when(heading_level(style).isNotNull(), F.concat(F.lit("Item_Nivel"), text(heading_level(style))))
        .when(name.contains("list bullet"), "marcador")
        .when(name.rlike("quote|citação|citacao"), "Citação")
        .when(num_format == "lowerLetter", "Item_Alinea_Letra")
        .when(num_format.isin("upperRoman", "lowerRoman"), "Item_Inciso_Romano")
        .when(num_format == "bullet", "marcador")
        .when(num_format.isNotNull(), family(counted))
        .when(by_format.isNotNull(), by_format)
        .when(F.coalesce(indent_quote, no), "Citação")
        .when(align == "center", "Texto_Centralizado")
        .when(align == "right", "Texto_Alinhado_Direita")
        .when(align == "left", "Texto_Alinhado_Esquerda")
        .when(first_line_pt > 8, "Texto_Justificado_Recuo_Primeira_Linha")
        .otherwise("Texto_Justificado")
    )


def convention(paragraphs: DataFrame, id_col: str, depth: Column, prose: Column) -> DataFrame:
    """(id, convention): paragraphs if most level-1 openers read as prose, strictly; else titles."""
    # prose is only looked at in openers: a CASE doesn't evaluate what it doesn't reach
    vote = F.when(depth == 1, F.when(prose, 1).otherwise(-1)).otherwise(0)
    return paragraphs.groupBy(id_col).agg(F.when(F.sum(vote) > 0, "paragrafos").otherwise("titulos").alias("convention"))


def with_convention(paragraphs: DataFrame, id_col: str, depth: Column, prose: Column) -> DataFrame:
    """``paragraphs`` with their document's convention, by a window: nothing is joined. ``prose`` is looked at in level-1 openers only."""
    votes = F.sum(F.when(depth == 1, F.when(prose, 1).otherwise(-1)).otherwise(0)).over(Window.partitionBy(id_col))
    return paragraphs.withColumn("convention", F.when(votes > 0, "paragrafos").otherwise("titulos"))


def body_size(runs: DataFrame, id_col: str, size: str, chars: str, pos: str, seen: str) -> DataFrame:
    """(id, body_size): the size with the most characters; on ties the one seen first. Empty runs don't count, unknown sizes and sizes without any ``pos``
    are never chosen: null if there is no other.

    ``seen`` is a number of its own for each run, in the order of the runs: it decides between sizes that begin at one ``pos``.
    """
    weights = runs.where(F.col(chars) > 0).groupBy(id_col, size).agg(F.sum(chars).alias("w"), F.min(pos).alias("p"), F.min(seen).alias("s"))
    order = F.when(F.col(size).isNotNull() & F.col("p").isNotNull(), F.struct("w", -F.col("p"), -F.col("s")))
    return weights.groupBy(id_col).agg(F.max_by(size, order).alias("body_size"))


def max_unless_unknown(value: Column) -> Column:
    """Maximum, but null if any value is null."""
    return F.when(F.count("*") == F.count(value), F.max(value))


def inherited(styles: DataFrame, key: str, parent: str, value: str, depth: int = S.INHERITANCE_DEPTH) -> DataFrame:
    """(key, value, steps): the first known value up the chain of parents, within ``depth`` steps; cycles end there.

    Pointers double: after k rounds every row knows the first value within 2**k - 1 steps and who comes
    next, so depth 10 takes four joins of the table with itself, however many styles there are.
    """
    walk = styles.select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(value).alias("v"), F.when(F.col(value).isNotNull(), 0).alias("steps"))
    reach = 1  # rows are settled for this many links of the chain, the first included
    while reach <= depth:
        up = walk.select(F.col("k").alias("k_"), F.col("p").alias("p_"), F.col("v").alias("v_"), F.col("steps").alias("s_"))
        joined = walk.join(up, F.col("v").isNull() & (F.col("p") == F.col("k_")), "left")
        walk = joined.select("k", F.when(F.col("v").isNull(), F.col("p_")).otherwise(F.col("p")).alias("p"), F.coalesce("v", "v_").alias("v"), F.coalesce("steps", F.col("s_") + reach).alias("steps"))
        reach *= 2
    near = F.col("steps") <= depth
    return walk.select(F.col("k").alias(key), F.when(near, F.col("v")).alias(value), F.when(near, F.col("steps")).alias("steps"))


def numbering(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame) -> DataFrame:
    """Format of numbered paragraphs: (num_id, ilvl) to its abstract list to its level; a miss is decimal, number 0 is none."""
    found = paragraphs.join(nums, "num_id", "left").join(levels, ["abstract_id", "ilvl"], "left")
    return found.withColumn("num_format", F.when(F.col("num_id") > 0, F.coalesce("format", F.lit("decimal")))).drop("format", "abstract_id")

"""Blocks to documents: joined in order, wrapped, named and written once per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import paths

COUNTERS = ["item-n1", "item-n2", "item-n3", "item-n4", "paragrafo-n1", "paragrafo-n2", "paragrafo-n3", "romano_maiusculo", "letra_minuscula"]


def joined_blocks(blocks: DataFrame, id_col: str, pos: str, html: str, out: str = "html") -> DataFrame:
    """(id, html): blocks of a document in order, one to a line."""
    rows = blocks.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(html).alias("h")))).alias("__b"))
    return rows.select(id_col, F.array_join(F.col("__b.h"), "\n").alias(out))


def block(class_name: Column, html: Column) -> Column:
    return F.concat(F.lit('<p class="'), class_name, F.lit('">'), html, F.lit("</p>"))


def html_document(body: Column, css: str = "") -> Column:
    """A whole page around a body, its counters set to zero."""
    reset = " ".join(f"{c} 0" for c in COUNTERS)
    head = f'<!DOCTYPE html>\n<html lang="pt-BR">\n<head>\n<meta charset="utf-8">\n<title>{S.OUTPUT_TITLE}</title>\n<style>\n{css}\nbody::before {{ content: ""; counter-reset: {reset}; }}\n</style>\n</head>\n<body>\n'
    return F.concat(F.lit(head), body, F.lit("\n</body>\n</html>\n"))


def result_json(name: Column, success: Column, errors: Column, warnings: Column, files: Column) -> Column:
    return F.to_json(F.struct(name.alias("nome_origem"), success.alias("sucesso"), errors.alias("erros"), warnings.alias("avisos"), files.alias("arquivos")))


def first_per_target(files: DataFrame, target: str, order: str) -> DataFrame:
    """``files`` with ``written``: the first input of each target wins, whatever the case of its letters and the dots in its path."""
    return files.withColumn("written", F.row_number().over(Window.partitionBy(paths.identity(F.col(target))).orderBy(order)) == 1)


def numbered_duplicates(files: DataFrame, name: str, order: str) -> DataFrame:
    """``files`` whose repeated names get (2), (3) and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return files.withColumn("__n", n).withColumn(name, F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), F.col("__n").cast("string"), F.lit(")")))).drop("__n")

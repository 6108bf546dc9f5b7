"""Tables: grid positions, merged cells, expansion of repeats and column widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import text as T


def grid_columns(cells: DataFrame, keys: list[str], order: str, span: str) -> DataFrame:
    """``cells`` with ``gridcol``: the spans of the row's cells before each."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("gridcol", F.coalesce(F.sum(span).over(w), F.lit(0)).cast("int"))


def column_count(cells: DataFrame, table: str, row: str, span: str) -> DataFrame:
    """(table, columns): the widest row's sum of spans."""
    return cells.groupBy(table, row).agg(F.sum(span).alias("s")).groupBy(table).agg(F.max("s").alias("columns"))


def merged_rows(cells: DataFrame, keys: list[str], order: str, continues: str) -> DataFrame:
    """Cells that start a vertical merge, with ``rowspan``: one more for each continuing cell below in the same column."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    opened = cells.withColumn("__g", F.sum((~F.col(continues)).cast("int")).over(upto)).where("__g > 0")
    return opened.withColumn("rowspan", F.count("*").over(Window.partitionBy(*keys, "__g")).cast("int")).where(~F.col(continues)).drop("__g")


def expand_repeats(cells: DataFrame, key: str, order: str, times: str, value: str, limit: int = S.REPEATED_COLUMNS) -> DataFrame:
    """(key, col, value, cut): repeated cells written out, at most ``limit`` in a row; empty repeats at the row's end go."""
    w = Window.partitionBy(key).orderBy(order)
    last_full = F.max(F.when(F.col(value) != "", F.col(order))).over(Window.partitionBy(key))
    kept = cells.withColumn("__l", last_full).where(F.col(order) <= F.col("__l"))
    kept = kept.withColumn("__before", F.coalesce(F.sum(times).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = F.greatest(F.lit(0), F.least(F.col(times), F.lit(limit) - F.col("__before"))).cast("int")
    total = F.sum(times).over(Window.partitionBy(key))
    kept = kept.withColumns({"__room": room, "cut": total > limit}).where("__room > 0")
    return kept.select(key, "cut", value, "__before", F.explode(F.sequence(F.lit(0), F.col("__room") - 1)).alias("__i")).select(key, (F.col("__before") + F.col("__i")).cast("int").alias("col"), value, "cut")


def equal_columns(widths: Column) -> Column:
    """More than one column, all within one point of each other."""
    return (F.size(widths) > 1) & (F.array_max(widths) - F.array_min(widths) <= 1)


def _tenths(pct: Column) -> Column:
    """Tenths, halves to even; what the last bits of a sum's order leave of a half counts as one."""
    return F.bround(F.bround(pct, 9), 1)


def content_shares(needs: Column, wants: Column) -> Column:
    """Percentages of a table's columns from what they need (longest words) and want (longest lines).

    If all get what they want, that decides; if even the needs are too much, the needs do; else what
    is left over is shared by what is still wanted. Then percentages, a floor that the wide columns
    pay for in proportion, tenths, and the last column takes the rest.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    room = F.lit(float(S.TABLE_CHARS))
    spare, still = room - total(needs), total(wants) - total(needs)
    mixed = F.zip_with(needs, wants, lambda n, w: n + spare * (w - n) / F.when(still > 0, still))
    base = F.when(total(wants) <= room, wants).when(total(needs) >= room, needs).otherwise(mixed)
    floor = F.lit(S.LEAST_COLUMN_PCT)

    def floored(pct: Column) -> Column:
        wide = F.filter(pct, lambda p: p >= floor)
        rest = 100 - floor * (F.size(pct) - F.size(wide))
        return F.when((F.size(wide) == F.size(pct)) | (F.size(wide) == 0), pct).otherwise(F.transform(pct, lambda p: F.when(p < floor, floor).otherwise(p * rest / total(wide))))

    # each step is a column of a one-element array, so that it is computed once
    def then(value: Column, step) -> Column:
        return F.get(F.transform(F.array(value), step), F.lit(0))

    pct = then(base, lambda b: F.transform(b, lambda x: 100 * x / total(b)))
    tenths = then(then(pct, floored), lambda p: F.transform(p, _tenths))
    return then(tenths, lambda t: F.when(F.size(t) > 0, F.concat(F.slice(t, 1, F.size(t) - 1), F.array(_tenths(100 - total(F.slice(t, 1, F.size(t) - 1)))))).otherwise(t))


def cell_measures(text: Column) -> tuple[Column, Column]:
    """(need, want) of a cell: its longest word and its longest line, one at least, with some slack."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda t: t != "")
    word = F.array_max(F.transform(F.flatten(F.transform(lines, T.words)), F.length))
    line = F.array_max(F.transform(lines, F.length))
    slack = lambda x: (F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) + S.CELL_SLACK).cast("double")
    return slack(word), slack(line)


def content_widths(cells: DataFrame, table: str | list[str], col: str, text: str) -> DataFrame:
    """(table, col, width): percentages of the columns from what their cells hold, by ``content_shares``."""
    keys = [table] if isinstance(table, str) else list(table)
    need, want = cell_measures(F.col(text))
    found = cells.select(*keys, col, need.alias("n"), want.alias("w")).groupBy(*keys, col).agg(F.max("n").alias("n"), F.max("w").alias("w"))
    whole = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("c"), "n", "w"))).alias("x"))
    shares = content_shares(F.col("x.n"), F.col("x.w"))
    return whole.select(*keys, F.explode(F.arrays_zip(F.col("x.c").alias("c"), shares.alias("p"))).alias("z")).select(*keys, F.col("z.c").alias(col), F.col("z.p").alias("width"))


def grid_percentages(columns: DataFrame, table: str, col: str, twips: str) -> DataFrame:
    """(table, col, width): grid widths as percentages in tenths; the last column takes the rest."""
    whole = Window.partitionBy(table)
    t = columns.withColumn("r", F.bround(100 * F.col(twips) / F.sum(twips).over(whole), 1)).withColumn("last", F.col(col) == F.max(col).over(whole))
    return t.select(table, col, F.bround(F.when(F.col("last"), 100 - (F.sum("r").over(whole) - F.col("r"))).otherwise(F.col("r")), 1).alias("width"))


def table_width(value: Column, kind: Column, text_area: Column) -> Column:
    """Width of a table in per cent of the text area, 10 to 100: twips, fiftieths of a per cent, or a per cent sign."""
    number = F.regexp_extract(value, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    pct = F.when(value.endswith("%"), number).when(kind == "pct", number / 50).when((kind == "dxa") & (text_area > 0), 100 * number / text_area)
    return F.when(pct > 0, F.greatest(F.lit(10), F.least(F.lit(100), F.bround(pct).cast("int"))))

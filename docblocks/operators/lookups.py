"""Lookups of a document's parts by key: bullets, notes, members of a set, formats of spans, list numbering, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Deepest level of a bullet.
DEEPEST_BULLET = 3


def bullet_level(style: Column, ilvl: Column | None = None) -> Column:
    """Level of a bullet, 0 to 3: from its numbering, else from the number in its style's name, which counts from one."""
    digit = F.regexp_extract(style, r"(\d+)", 1)
    named = F.when(digit != "", digit.cast("int") - 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(DEEPEST_BULLET), named if ilvl is None else F.coalesce(ilvl, named)))


def numbered_notes(refs: DataFrame, notes: DataFrame, id_col: str = "doc_id", note: str = "note", pos: str = "pos") -> DataFrame:
    """Notes numbered by the first place that refers to them; references without a note, and notes without one, are left out."""
    first = refs.groupBy(id_col, note).agg(F.min(pos).alias("first_")).join(notes, note)
    number = F.dense_rank().over(Window.partitionBy(id_col).orderBy("first_"))
    return first.withColumn("number", number).drop("first_")


def flagged(rows: DataFrame, members: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: whether the row's keys are among ``members``."""
    marked = members.select(*keys).distinct().withColumn(out, F.lit(True))
    return rows.join(marked, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def span_formats(spans: DataFrame, styles: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """``spans`` with the flags of their styles; without a style, or with one that says nothing, all are false."""
    joined = spans.join(styles.select(key, *flags), key, "left")
    return joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def list_numbering(items: DataFrame, levels: DataFrame, list_style: str = "list_style", parent: str = "parent_style", level: str = "level") -> DataFrame:
    """``items`` with the numbering of their list style and level (levels: list_style, level, and more columns); a list
    without a style has its parent's. A level without numbering leaves nulls: its items are bullets."""
    style = F.coalesce(F.col(list_style), F.col(parent))
    keyed = items.withColumn("style_", style)
    spec = levels.withColumnsRenamed({list_style: "style_"})
    return keyed.join(spec, ["style_", level], "left").drop("style_")


def targets(rows: DataFrame, relationships: DataFrame, key: str) -> DataFrame:
    """``rows`` with what their relationship points at, null where there is none."""
    return rows.join(relationships, key, "left")

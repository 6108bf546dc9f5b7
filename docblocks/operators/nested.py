"""Lists inside lists: what a list inherits from those around it, how deep it is, and the numbers of its items.

A tree comes as rows (document, node, parent, pos, kind): lists hold items, items hold paragraphs and further lists. Lists are
linked to the lists around them, and pointers double: after k rounds a list knows the nearest style and the number of lists
within 2**k - 1 of those around it, so any depth d takes about log2(d) joins. Numbers are a running count by list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docblocks.functions import text as T
from docblocks.lineage import cut
from docblocks.operators import ordered as O

LIST, ITEM, HEADER, PARAGRAPH, TITLE, TABLE = "list", "item", "header", "p", "title", "table"
#: Deepest level that a bullet shows.
DEEPEST = 3


def around(nodes: DataFrame, doc: str = "doc_id", kind: str = "kind", style: str = "style", outer: str | None = None) -> DataFrame:
    """(doc, node, list_style, level) of every list: its own style or the nearest around it, and how many lists are around it.

    The tree has no circles. ``nodes``: (doc, node, parent, kind, style). Where the list around each list is known already, ``outer``
    names its column; then ``nodes`` needs no items and no parents. A round joins only the lists that aren't at the top yet.
    """
    d = F.col(doc)
    up = F.col(outer or "parent")
    state = nodes.where(F.col(kind) == LIST).select(d.alias("d"), F.col("node").alias("n"), up.alias("up"), F.col(style).alias("s"))
    if outer is None:
        holders = nodes.where(F.col(kind).isin(ITEM, HEADER)).select(d.alias("d_"), F.col("node").alias("i_"), F.col("parent").alias("up_"))
        held = state.join(holders, F.col("d").eqNullSafe(F.col("d_")) & (F.col("up") == F.col("i_")), "left")
        state = held.select("d", "n", F.col("up_").alias("up"), "s")
    state = cut(state.withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1)))
    settled, below = state.where("up is null"), state.where("up is not null")
    while not below.isEmpty():
        other = settled.union(below).select(F.col("d").alias("d_"), F.col("n").alias("n_"), F.col("up").alias("up_"), F.col("s").alias("s_"), F.col("level").alias("l_"))
        joined = below.join(other, F.col("d").eqNullSafe(F.col("d_")) & (F.col("up") == F.col("n_")), "left")
        state = cut(joined.select("d", "n", F.col("up_").alias("up"), F.coalesce("s", "s_").alias("s"), (F.col("level") + F.coalesce("l_", F.lit(0))).alias("level")))
        settled, below = settled.union(state.where("up is null")), state.where("up is not null")
    return settled.select(F.col("d").alias(doc), F.col("n").alias("node"), F.col("s").alias("list_style"), "level")


def numbered(rows: DataFrame, specs: DataFrame, by: list[str], pos: str = "pos", start: str = "start") -> DataFrame:
    """``rows`` with number and label; a bullet has neither.

    ``rows``: (the columns ``by``, which name a list; pos, kind, start, and list_style and level of the list), one an item or header.
    ``specs``: (list_style, level from 1, num_type, prefix, suffix, first) of the levels that count. An item may say its own number
    (``start``), from which the next ones go on; a header is no item and isn't counted, but a number that it says counts.
    """
    spec = specs.select(F.col("list_style").alias("s_"), (F.col("level") - 1).alias("l_"), "num_type", "prefix", "suffix", "first")
    found = rows.join(spec, (F.col("list_style") == F.col("s_")) & (F.col("level") == F.col("l_")), "left").withColumn("start_", F.col(start))
    counted = F.col("num_type").isNotNull() & (F.col("kind") == ITEM)
    order = Window.partitionBy(*by).orderBy(F.col(pos).asc_nulls_last())
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("nth_", F.coalesce(F.sum(counted.cast("int")).over(before), F.lit(0)))
    base = F.last(F.when(F.col("start_").isNotNull(), F.col("start_") - F.col("nth_")), True).over(upto)
    number = F.when(counted, F.coalesce(base, F.coalesce("first", F.lit(1))) + F.col("nth_")).cast("int")
    label = F.concat(F.coalesce("prefix", F.lit("")), T.list_number(F.col("number"), F.col("num_type")), F.coalesce("suffix", F.lit("")))
    found = found.withColumn("number", number)
    return found.select(*rows.columns, "number", F.when(F.col("number").isNotNull(), label).alias("label"))


def items(nodes: DataFrame, specs: DataFrame, doc: str = "doc_id", pos: str = "pos", start: str = "start") -> DataFrame:
    """(doc, node, pos, level, number, label): the items of all lists with their depth and number; ``specs`` as in ``numbered``."""
    lists = around(nodes, doc).withColumnsRenamed({"node": "list", doc: "d_"})
    own = nodes.where(F.col("kind").isin(ITEM, HEADER)).select(doc, "node", "parent", pos, "kind", start)
    rows = own.join(lists, F.col(doc).eqNullSafe(F.col("d_")) & (F.col("parent") == F.col("list"))).drop("d_")
    return numbered(rows, specs, [doc, "list"], pos, start).select(doc, "node", pos, F.col("level").cast("int").alias("level"), "number", "label")


def bullet_depth(level: Column) -> Column:
    return F.least(level, F.lit(DEEPEST))


def quotations(elements: DataFrame, doc: str = "doc_id", pos: str = "pos", kind: str = "kind", text: str = "text") -> DataFrame:
    """(doc, pos): the paragraphs that a quotation of more than one line encloses; titles, lists and tables end a span.

    ``elements`` are the outermost ones of a document in order; empty paragraphs and titles are left out, they end nothing.
    """
    bare = T.strip(F.col(text))
    seen = elements.where(F.col(kind).isin(LIST, TABLE) | (bare != ""))
    rows = seen.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.when(F.col(kind) == PARAGRAPH, F.col(text)).alias("t")))).alias("x"))
    return rows.select(doc, "x", F.explode(O.quoted_spans(F.col("x.t"))).alias("at")).select(doc, F.get("x", F.col("at"))["p"].alias(pos))

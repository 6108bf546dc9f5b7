"""Operators over ordered sequences: runs, counters, folds over one document's rows.

What a window can say is a window. Greedy rules, in which a decision depends on the decision before,
are folds: ``aggregate`` over the document's sorted array, so that no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import text as T


def by_doc(*order: str, id_col: str = "doc_id"):
    return Window.partitionBy(id_col).orderBy(*order)


def runs(frame: DataFrame, id_col: str, pos: str, key: str, out: str = "run") -> DataFrame:
    """``frame`` with a number for each stretch of equal neighbours."""
    w = by_doc(pos, id_col=id_col)
    changed = F.coalesce(~F.col(key).eqNullSafe(F.lag(key).over(w)), F.lit(True)) | F.lag(pos).over(w).isNull()
    return frame.withColumn("__c", changed.cast("int")).withColumn(out, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def split_header(frame: DataFrame, id_col: str, pos: str, opens: Column) -> DataFrame:
    """``frame`` with ``header``: what stands before the first opener; without any, nothing is."""
    first = F.min(F.when(opens, F.col(pos))).over(Window.partitionBy(id_col))
    return frame.withColumn("header", F.coalesce(F.col(pos) < first, F.lit(False)))


def counters(frame: DataFrame, id_col: str, pos: str, level: str, deepest: int = 4) -> DataFrame:
    """``frame`` with n1..n<deepest>: running numbers, each starting anew when a shallower one advances."""
    keys = [id_col]
    for k in range(1, deepest + 1):
        w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        frame = frame.withColumn(f"n{k}", F.sum((F.col(level) == k).cast("int")).over(w).cast("int"))
        keys.append(f"n{k}")
    return frame


def level_faults(frame: DataFrame, id_col: str, pos: str, level: str) -> DataFrame:
    """(id, first_level, jump_from, jump_to): the first level, and the first step down by more than one."""
    w = by_doc(pos, id_col=id_col)
    steps = frame.where(F.col(level) > 0).withColumn("__p", F.lag(level).over(w))
    jump = F.struct(F.col("__p").alias("a"), F.col(level).alias("b"))
    out = steps.groupBy(id_col).agg(F.min_by(level, pos).alias("first_level"), F.min_by(jump, F.when(F.col(level) > F.col("__p") + 1, F.col(pos))).alias("j"))
    return out.select(id_col, "first_level", F.col("j.a").alias("jump_from"), F.col("j.b").alias("jump_to"))


def trailing_run(flags: Column) -> Column:
    """How many of an array's last flags are true."""
    return F.aggregate(flags, F.lit(0), lambda n, x: F.when(x, n + 1).otherwise(0))


def signature_tail(flags: Column, short: Column) -> Column:
    """Lines of the signature at a document's end.

    ``flags``: the line is centred and short; ``short``: the text of a short line of no class of its
    own, else null. The trailing flagged lines count if there are two or more and others before
    them. Or, in the trailing short lines, all from the first mark after which no line but a mark
    ends like a sentence, if those are two or more and not the whole document.
    """
    centred = trailing_run(flags)
    centred = F.when((centred == F.size(flags)) | (centred < S.SIGNATURE_LINES), 0).otherwise(centred)
    start = F.struct(F.lit(0).alias("from_mark"), F.lit(False).alias("open"))

    def step(acc: Column, t: Column) -> Column:
        mark = T.is_signature_mark(t)
        ends = F.coalesce(t.rlike(r"[.,:;]$"), F.lit(False)) & ~mark
        keep = acc["open"] & t.isNotNull() & ~ends
        count = F.when(keep, acc["from_mark"] + 1).when(mark, 1).otherwise(0)
        return F.struct(count.alias("from_mark"), (keep | mark).alias("open"))

    by_mark = F.aggregate(short, start, step, lambda acc: acc["from_mark"])
    by_mark = F.when((by_mark >= S.SIGNATURE_LINES) & (by_mark < F.size(short)), by_mark).otherwise(0)
    return F.greatest(centred, by_mark)


def _closes_at_end(text: Column, mark: Column) -> Column:
    """One closing mark, and after it only punctuation and one reference in parentheses."""
    after = F.substring_index(text, mark, -1) if isinstance(mark, str) else F.element_at(F.split(text, F.concat(F.lit("\\Q"), mark, F.lit("\\E"))), -1)
    count = F.size(F.split(text, F.concat(F.lit("\\Q"), mark, F.lit("\\E")), -1)) - 1
    return (count == 1) & after.rlike(r"^[\s.,;:]*(?:\([^()]*\)[\s.,;:]*)?$")


def quoted_spans(texts: Column) -> Column:
    """Positions (from 0) of the paragraphs that quotation marks enclose; null texts (tables) break a span.

    A fold keeps the open span's start and its marks; a span that fails gives its first paragraph up
    and the search goes on from the next, which a paragraph of the span may open anew: those are kept
    as a list of candidates, so one pass decides.
    """
    opening = F.create_map(*[F.lit(x) for pair in S.QUOTES.items() for x in pair])
    state = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<s:int,o:string,c:string>>").alias("open"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        t = T.strip(raw)
        first = F.substring(t, 1, 1)
        mark = F.element_at(opening, first)
        rest = F.substr(t, F.lit(2))
        # spans that are open: this paragraph closes, breaks or leaves each as it is; the earliest that closes wins
        seen = F.transform(
            acc["open"],
            lambda o: F.struct(
                o["s"].alias("s"),
                o["o"].alias("o"),
                o["c"].alias("c"),
                F.when(F.startswith(t, o["o"]), rest).otherwise(t).alias("body"),
            ),
        )
        has = F.filter(seen, lambda o: F.contains(o["body"], o["c"]))
        closed = F.filter(has, lambda o: _closes_at_end(o["body"], o["c"]))
        done = F.array_min(F.transform(closed, lambda o: o["s"]))
        left = F.transform(F.filter(seen, lambda o: ~F.contains(o["body"], o["c"])), lambda o: F.struct(o["s"].alias("s"), o["o"].alias("o"), o["c"].alias("c")))
        # an earlier span that stays open hides the ones that start inside it
        hidden = F.array_min(F.transform(left, lambda o: o["s"]))
        really = done.isNotNull() & (hidden.isNull() | (done < hidden))
        inside = F.element_at(F.split(rest, F.concat(F.lit("\\Q"), mark, F.lit("\\E"))), 1)
        single = F.contains(rest, mark) & _closes_at_end(rest, mark) & (F.contains(T.strip(inside), F.lit("\n")) | (F.length(T.strip(inside)) >= S.QUOTE_LETTERS))
        opens = mark.isNotNull() & ~F.contains(rest, mark)
        i = acc["i"]
        new_open = F.when(raw.isNull() | really, F.array().cast("array<struct<s:int,o:string,c:string>>")).otherwise(F.concat(left, F.when(F.coalesce(opens, F.lit(False)), F.array(F.struct(i.alias("s"), first.alias("o"), mark.alias("c")))).otherwise(F.array().cast("array<struct<s:int,o:string,c:string>>"))))
        found = F.when(really, F.sequence(done, i)).when(F.coalesce(single, F.lit(False)) & (F.size(left) == 0), F.array(i)).otherwise(F.array().cast("array<int>"))
        return F.struct((i + 1).cast("int").alias("i"), new_open.alias("open"), F.concat(acc["out"], F.when(raw.isNull(), F.array().cast("array<int>")).otherwise(found)).alias("out"))

    return F.aggregate(texts, state, step, lambda acc: acc["out"])


def fence_blocks(lines: Column) -> Column:
    """For each line, true inside a code block or on its fence; a fence that never closes is text.

    A block opens at a line of three or more backticks (with a language at most) and closes at the
    first line of at least as many and nothing else; what stands between is content.
    """
    state = F.struct(F.lit(0).alias("ticks"), F.array().cast("array<boolean>").alias("done"), F.array().cast("array<boolean>").alias("held"))

    def step(acc: Column, line: Column) -> Column:
        ticks = F.length(F.regexp_extract(line, r"^(`{3,})[^`]*$", 1))
        bare = line.rlike(r"^`{3,}\s*$")
        is_open = acc["ticks"] > 0
        closes = is_open & bare & (ticks >= acc["ticks"])
        opens = ~is_open & (ticks > 0)
        held = F.concat(acc["held"], F.array(F.lit(True)))
        empty = F.array().cast("array<boolean>")
        return F.struct(
            F.when(closes, 0).when(opens, ticks).otherwise(acc["ticks"]).cast("int").alias("ticks"),
            F.when(closes, F.concat(acc["done"], held)).when(is_open | opens, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.lit(False)))).alias("done"),
            F.when(closes, empty).when(is_open | opens, held).otherwise(empty).alias("held"),
        )

    return F.aggregate(lines, state, step, lambda acc: F.concat(acc["done"], F.transform(acc["held"], lambda _: F.lit(False))))


def list_levels(levels: Column) -> Column:
    """Relative levels of a list's items: from the first item's, never more than one deeper than the item before."""
    start = F.struct(F.lit(None).cast("int").alias("base"), F.lit(-1).alias("prev"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        base = F.coalesce(acc["base"], level)
        mine = F.greatest(F.lit(0), F.least(level - base, acc["prev"] + 1)).cast("int")
        return F.struct(base.alias("base"), mine.alias("prev"), F.concat(acc["out"], F.array(mine)).alias("out"))

    return F.aggregate(levels, start, step, lambda acc: acc["out"])


def list_html(items: Column) -> Column:
    """Nested lists from an array of (level, html of an item with its closing tag): the first item sets the margin."""
    first = F.get(items, F.lit(0))["level"]
    opens = F.when(first > 0, F.concat(F.lit('<ul style="margin-left:'), (2 * first).cast("string"), F.lit('em">'))).otherwise(F.lit("<ul>"))
    start = F.struct(F.lit("").alias("out"), F.lit(-1).alias("prev"))
    cut = F.length(F.lit("</li>"))

    def step(acc: Column, item: Column) -> Column:
        level = F.greatest(F.lit(0), F.least(item["level"] - first, acc["prev"] + 1)).cast("int")
        back = F.concat(F.lit("</li>"), F.repeat(F.lit("</ul></li>"), F.greatest(acc["prev"] - level, F.lit(0))))
        joint = F.when(acc["prev"] < 0, "").when(level > acc["prev"], "<ul>").otherwise(back)
        return F.struct(F.concat(acc["out"], joint, F.substr(item["html"], F.lit(1), F.length(item["html"]) - cut)).alias("out"), level.alias("prev"))

    return F.aggregate(items, start, step, lambda acc: F.concat(opens, acc["out"], F.lit("</li>"), F.repeat(F.lit("</ul></li>"), F.greatest(acc["prev"], F.lit(0))), F.lit("</ul>")))


def glue_numbers(lines: Column) -> Column:
    """Lines that are fragments of a number joined to the next line with text; blank lines between them go."""
    start = F.struct(F.lit("").alias("number"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        piece = line.rlike(r"^(?:\d{1,2}(?:\.\d{1,2})*\.?|\.)$")
        pending = acc["number"] != ""
        text = F.when(pending, F.concat(acc["number"], F.lit(" "), line)).otherwise(line)
        keep = ~piece & ~((line == "") & pending)
        return F.struct(
            F.when(piece, F.concat(acc["number"], line)).when((line == "") & pending, acc["number"]).otherwise("").alias("number"),
            F.when(keep, F.concat(acc["out"], F.array(text))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["number"] != "", F.concat(acc["out"], F.array(acc["number"]))).otherwise(acc["out"]))


def regroup(frame: DataFrame, id_col: str, pos: str, line: str) -> DataFrame:
    """(id, first, kind, text): paragraphs of extracted text. Header lines are one each until the first item or
    blank line; then an item or a caps heading opens a paragraph, a blank line ends one, others go on."""
    w = by_doc(pos, id_col=id_col)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    text = F.col(line)
    item = text.rlike(r"^\d{1,2}(?:\.\d{1,2})*\.\s+\S.*$")
    blank = text == ""
    # an item ends the header with itself, a blank line after itself
    ended = F.coalesce(F.max((item | blank).cast("int")).over(before), F.lit(0)) == 1
    header = ~ended & ~item & ~blank
    alone = header | (~header & ~item & T.is_caps_heading(text))
    frame = frame.withColumns({"__header": header, "__alone": alone, "__item": item, "__blank": blank})
    opens = F.col("__alone") | F.col("__item") | F.coalesce(F.lag("__alone").over(w), F.lit(True)) | F.coalesce(F.lag("__blank").over(w), F.lit(True))
    grouped = frame.withColumn("__o", opens.cast("int")).withColumn("__g", F.sum("__o").over(upto)).where(~F.col("__blank"))
    out = grouped.groupBy(id_col, "__g").agg(F.min(pos).alias("first"), F.bool_or("__header").alias("h"), F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), text.alias("t")))).alias("b"))
    joined = T.strip(F.regexp_replace(F.array_join("b.t", " "), r"(?U)\s+", " "))
    return out.select(id_col, "first", F.when(F.col("h"), "cabecalho").otherwise("corpo").alias("kind"), F.when(F.col("h"), F.element_at("b.t", 1)).otherwise(joined).alias("text"))


def list_counter(frame: DataFrame, key: str, pos: str, explicit: str) -> DataFrame:
    """``frame`` with ``number``: the last explicit value of the list plus the items since, from 1."""
    w = Window.partitionBy(key).orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.withColumn("__n", F.row_number().over(w))
    base = F.coalesce(F.last(F.when(F.col(explicit).isNotNull(), F.col(explicit) - F.col("__n")), True).over(upto), F.lit(0))
    return frame.withColumn("number", (base + F.col("__n")).cast("int")).drop("__n")


def spread_signatures(frame: DataFrame, id_col: str, pos: str, signed: str, text: str) -> DataFrame:
    """Blocks with a separator before every signature mark but the first of its run: (id, pos, part, text)."""
    marked = runs(frame, id_col, pos, signed).withColumn("__m", F.col(signed) & T.is_signature_mark(F.col(text)))
    nth = F.sum(F.col("__m").cast("int")).over(Window.partitionBy(id_col, "run").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__k", nth)
    line = F.when(F.col("__m"), F.lit(S.SIGNATURE_MARK)).otherwise(F.col(text))
    parts = F.when(F.col("__m") & (F.col("__k") > 1), F.array(F.lit("&nbsp;"), line)).otherwise(F.array(line))
    return marked.select(id_col, pos, F.posexplode(parts).alias("part", "text"))

"""Aggregates over documents and batches: formats of paragraphs, quotations, warnings, classes, totals, and what a list shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import text as T

#: Entries that a list of excerpts shows, and lines of a report; what stands for a file's name in it (fixed values).
SHOWN_EXCERPTS, SHOWN_LINES, NO_NAME, MORE = 5, 10, "<arquivo>", "e mais %d."
#: Suffixes of words that are names of documents (fixed values).
NAME_SUFFIXES = r"docx?|odt|pdf|md|txt|rtf|html?"


def paragraph_format(paragraphs: DataFrame, runs: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """(key, flags): true where every visible run of a paragraph says so; a paragraph without runs says nothing, so false."""
    named = runs.select(key, *[c.alias(n) for n, c in flags.items()])
    joined = paragraphs.select(key).join(named, key, "left")
    return joined.groupBy(key).agg(*[F.coalesce(F.bool_and(n), F.lit(False)).alias(n) for n in flags])


def quotation_counts(paragraphs: DataFrame, id_col: str, pos: str, text: str, by_indent: Column, by_marks: Column) -> DataFrame:
    """(id, by_indent, by_marks, excerpts): two separate counts and the beginnings of all of them in order."""
    listed = F.sort_array(F.collect_list(F.when(by_indent | by_marks, F.struct(F.col(pos).alias("p"), T.excerpt(F.col(text)).alias("e")))))
    out = paragraphs.groupBy(id_col).agg(F.count_if(by_indent).alias("by_indent"), F.count_if(by_marks).alias("by_marks"), listed.alias("l"))
    return out.select(id_col, "by_indent", "by_marks", F.col("l.e").alias("excerpts"))


def any_of(rows: DataFrame, id_col: str, signs: dict[str, Column]) -> DataFrame:
    """(id, signs): whether any row of a document shows each of them."""
    return rows.groupBy(id_col).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in signs.items()])


def batch_totals(results: DataFrame, by: list[str], ok: Column, quotations: Column) -> DataFrame:
    """Documents, those converted, quotations found and the documents that have any, for each group."""
    return results.groupBy(*by).agg(F.count("*").alias("documents"), F.count_if(ok).alias("converted"), F.sum(quotations).alias("quotations"), F.count_if(quotations > 0).alias("with_quotations"))


def used_classes(html: Column) -> Column:
    """Distinct classes of a document's elements, in order of their names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit('class="([^"]+)"'), F.lit(1))))


def unknown_classes(used: Column, known: list[str] = S.CLASSES) -> Column:
    """Classes that the catalogue doesn't have."""
    return F.array_sort(F.array_except(used, F.array(*[F.lit(c) for c in known])))


def missing_classes(html: Column, css: Column) -> Column:
    """Classes that a page uses and its style sheet has no rule for."""
    ruled = F.regexp_extract_all(css, F.lit(r"\.([\p{L}_][\p{L}\p{N}_-]*)"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(F.flatten(F.transform(used_classes(html), lambda c: F.split(c, " ")))), ruled))


def shown(entries: Column, limit: int = SHOWN_EXCERPTS) -> tuple[Column, Column]:
    """(the first entries of a list, how many more there are)."""
    return F.slice(entries, 1, limit), F.greatest(F.size(entries) - limit, F.lit(0)).cast("long")


def formats(names: Column) -> Column:
    """Distinct suffixes of a selection of files, in order."""
    return F.array_sort(F.array_distinct(F.transform(names, T.suffix)))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): of each session's selections, the last one counts."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def outcomes(results: DataFrame, name: str, ok: str) -> DataFrame:
    """(suffix, ok, n): conversions by format and outcome, without any name."""
    return results.groupBy(T.suffix(F.col(name)).alias("suffix"), F.col(ok).alias("ok")).agg(F.count("*").alias("n"))


def squeeze_blank_lines(text: Column) -> Column:
    """Three line breaks or more in a row are two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def changelog(lines: DataFrame, id_col: str, pos: str, line: str) -> DataFrame:
    """(id, section, title, entries): a history cut at its second-level headings; entries are its list items, continued lines joined."""
    text = F.col(line)
    whole = Window.partitionBy(id_col).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    opens = text.rlike(r"^##\s+\S")
    rows = lines.withColumn("section", F.sum(opens.cast("int")).over(whole)).where("section > 0")
    item = text.rlike(r"^\s*[-*]\s+\S")
    rows = rows.withColumn("entry", F.sum(item.cast("int")).over(Window.partitionBy(id_col, "section").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    bare = T.strip(F.regexp_replace(line, r"^\s*[-*]\s+", ""))
    parts = rows.groupBy(id_col, "section", "entry").agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.when(opens, F.regexp_replace(line, r"^##\s+", "")).alias("h"), F.when(~opens & (bare != ""), bare).alias("t")))).alias("x"))
    joined = parts.select(id_col, "section", "entry", F.array_join(F.array_compact(F.col("x.h")), " ").alias("h"), F.array_join(F.array_compact(F.col("x.t")), " ").alias("t"))
    out = joined.groupBy(id_col, "section").agg(F.max(F.when(F.col("entry") == 0, F.col("h"))).alias("title"), F.sort_array(F.collect_list(F.when(F.col("entry") > 0, F.struct("entry", "t")))).alias("e"))
    return out.select(id_col, "section", T.strip(F.col("title")).alias("title"), F.col("e.t").alias("entries"))


def roll_up(results: DataFrame, suffix: str = "suffix", ok: str = "ok", quotes: str = "quotes", headers: str = "headers", warnings: str = "warnings") -> DataFrame:
    """(by, suffix, ok, documents, converted, with_quotes, quotes, with_headers, headers, warnings): all results, by suffix and by outcome, in one pass.

    ``by`` is "all", "suffix" or "ok"; ``quotes`` and ``headers`` are counts, ``warnings`` is an array. A failed document counts as one and adds nothing else.
    """
    done = F.col(ok)
    plain = results.select(F.col(suffix).alias("suffix"), done.alias("ok"), *[F.when(done, F.coalesce(c, F.lit(0))).otherwise(0).alias(n) for n, c in (("quotes", F.col(quotes)), ("headers", F.col(headers)), ("warnings", F.size(warnings)))])
    sets = plain.groupingSets([[], ["suffix"], ["ok"]], "suffix", "ok")
    by = F.when(F.grouping("suffix") == 0, "suffix").when(F.grouping("ok") == 0, "ok").otherwise("all")
    return sets.agg(
        by.alias("by"), F.count("*").alias("documents"), F.count_if("ok").alias("converted"), F.count_if(F.col("quotes") > 0).alias("with_quotes"), F.sum("quotes").alias("n_quotes"),
        F.count_if(F.col("headers") > 0).alias("with_headers"), F.sum("headers").alias("n_headers"), F.sum("warnings").alias("n_warnings"),
    ).select("by", "suffix", "ok", "documents", "converted", "with_quotes", F.col("n_quotes").alias("quotes"), "with_headers", F.col("n_headers").alias("headers"), F.col("n_warnings").alias("warnings"))


def first_lines(results: DataFrame, name: str, order: str, lines: str, suffix: str = "suffix", limit: int = SHOWN_LINES) -> DataFrame:
    """(by, suffix, lines, more): "name: line" of the first lines in order of all results and of each suffix, and how many follow.

    Lines are ranked by group with no more than ``limit`` of them kept a task before they meet, so no group is ever collected.
    """
    rows = results.select(F.col(suffix).alias("suffix"), F.col(order).alias("at"), F.col(name).alias("name"), F.posexplode(lines).alias("nth", "line"))
    groups = F.array(F.struct(F.lit("all").alias("by"), F.lit(None).cast("string").alias("suffix")), F.struct(F.lit("suffix").alias("by"), F.col("suffix").alias("suffix")))
    keyed = rows.select(F.explode(groups).alias("g"), "at", "nth", F.concat_ws(": ", "name", "line").alias("line")).select("g.*", "at", "nth", "line")
    place = F.row_number().over(Window.partitionBy("by", "suffix").orderBy("at", "nth"))
    few = keyed.withColumn("place", place).where(F.col("place") <= limit).groupBy("by", "suffix").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("x"))
    totals = keyed.groupBy("by", "suffix").agg(F.count("*").alias("n")).withColumnsRenamed({"by": "b_", "suffix": "s_"})
    joined = few.join(totals, (F.col("by") == F.col("b_")) & F.col("suffix").eqNullSafe(F.col("s_")))
    return joined.select("by", "suffix", F.col("x.line").alias("lines"), F.greatest(F.col("n") - limit, F.lit(0)).alias("more"))


def _longest_first(names: Column) -> Column:
    """Names with and without their suffix, the longest first; very short ones are left out."""
    bare = F.transform(names, lambda n: F.regexp_replace(n, r"\.[^.]+$", ""))
    known = F.filter(F.array_distinct(F.concat(names, bare)), lambda n: F.length(n) > 2)
    return F.sort_array(F.transform(known, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))["n"]


def _cleaned(text: Column, longest: Column) -> Column:
    clean = F.aggregate(longest, text, lambda t, n: F.replace(t, n, F.lit(NO_NAME)))
    return F.regexp_replace(clean, rf"(?i)[^\s\[\]:|\"'()]+\.({NAME_SUFFIXES})\b", NO_NAME)


def without_names(text: Column, names: Column) -> Column:
    """A line of a report in which no file has a name: those of ``names``, with and without their suffix, the longest first, then any word that looks like one."""
    return _cleaned(text, _longest_first(names))


def report_lines(lines: Column, names: Column, limit: int = SHOWN_LINES) -> Column:
    """The lines that a report shows, without names, and a last one that counts the others; names are put in order once, not for every line."""
    shown_ = T.let(_longest_first(names), lambda longest: F.transform(F.slice(lines, 1, limit), lambda t: F.concat(F.lit("- "), _cleaned(t, longest))))
    more = F.size(lines) - limit
    return F.concat(shown_, F.when(more > 0, F.array(F.concat(F.lit("- "), F.format_string(MORE, more)))).otherwise(F.array().cast("array<string>")))


# Sentences of the report (fixed values): what was found, by one or more; whether it was converted.
_ONE_OR_MORE = ("1 parágrafo", "%d parágrafos")
_BY_INDENT = ("recuado e em fonte menor que a do texto", "recuados e em fonte menor que a do texto")
_BY_MARKS = ("entre aspas com mais de uma linha", "em citações entre aspas com mais de uma linha")
_BY_BOTH = "(%d recuados e em fonte menor, %d entre aspas)"
_CONVERTED = ("foi convertido como Citação.", "foram convertidos como Citação.")
_OFFERED = ("parece citação e saiu como texto comum. Para convertê-lo, use --citacao-por-recuo.", "parecem citação e saíram como texto comum. Para convertê-los, use --citacao-por-recuo.")
_NO_HEADER = "Nenhum parágrafo foi omitido: o documento não tem item 1 depois de um cabeçalho."
_HEADER = ("1 parágrafo antes do item 1 foi omitido.", "%d parágrafos antes do item 1 foram omitidos.")
_REPORT = ("RELATÓRIO DE CONVERSÃO PARA O SEI", "Total processados: %d | Sucessos: %d | Falhas: %d")
_OK, _FAILED = "OK   %s -> %s", "FALHA %s:"


def quotation_sentence(by_indent: Column, by_marks: Column, applied: Column) -> Column:
    """What became of the paragraphs that look like quotations; null where there are none."""
    n = by_indent + by_marks
    number = lambda pair: F.when(n == 1, pair[0]).otherwise(pair[1])
    count = F.when(n == 1, _ONE_OR_MORE[0]).otherwise(F.format_string(_ONE_OR_MORE[1], n))
    kind = F.when(by_marks == 0, number(_BY_INDENT)).when(by_indent == 0, number(_BY_MARKS)).otherwise(F.format_string(_BY_BOTH, by_indent, by_marks))
    return F.when(n > 0, F.concat_ws(" ", count, kind, F.when(applied, number(_CONVERTED)).otherwise(number(_OFFERED))))


def header_sentence(n: Column, applied: Column) -> Column:
    """What was left out before the first item, or that nothing was; null where nobody asked for it."""
    return F.when(applied, F.when(n == 0, _NO_HEADER).when(n == 1, _HEADER[0]).otherwise(F.format_string(_HEADER[1], n)))


def document_lines(name: Column, ok: Column, target: Column, warnings: Column, errors: Column, quotations: Column, header: Column) -> Column:
    """The lines of one document in the text report."""
    said = lambda label, texts: F.transform(texts, lambda t: F.concat(F.lit(f"     {label}: "), t))
    one = lambda label, text: F.when(text.isNotNull(), F.array(F.concat(F.lit(f"     {label}: "), text))).otherwise(F.array().cast("array<string>"))
    good = F.concat(F.array(F.format_string(_OK, name, target)), said("aviso", warnings), one("citação", quotations), one("cabeçalho", header))
    return F.when(ok, good).otherwise(F.concat(F.array(F.format_string(_FAILED, name)), said("erro", errors)))


def total_lines(documents: int, converted: int, failed: int) -> tuple[list[str], list[str]]:
    """What stands before and after the lines of the documents."""
    return ["=" * 60, _REPORT[0], "=" * 60], ["-" * 60, _REPORT[1] % (documents, converted, failed), "=" * 60]

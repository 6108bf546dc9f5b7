"""Queries of the Markdown and plain text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docblocks.functions import text as T
from docblocks.operators import markdown as M
from docblocks.plans.registry import ALL_LINES, FENCES, LINES, all_lines, lines, query, strip_sql, words_sql

#: What is put before every line by its position, so that each kind of block occurs among those that the lines are of themselves.
_MARKED = "CASE pos % 8 WHEN 0 THEN '## ' || line WHEN 1 THEN '> ' || line WHEN 2 THEN '  - ' || line WHEN 3 THEN '- [x] ' || line WHEN 4 THEN '| ' || line || ' | b |' WHEN 5 THEN '---' WHEN 6 THEN concat('~~', line, '~~ ~~', pos, CASE WHEN pos % 16 < 8 THEN '.~~' ELSE '' END) ELSE line END"
_CLASSED = r"""regexp_matches(line, '(?is)^<p\s+class=["''][^"'']+["'']>.*</p>$')"""


def _separator(marks: str) -> str:
    """A line of three or more of one mark, written out for each."""
    return "'^\\s*(" + "|".join(rf"{m}(\s*{m}){{2,}}" for m in marks) + ")\\s*$'"


def _ladder(markdown: bool) -> str:
    extra = r"""WHEN regexp_matches(line, '^>\s?') THEN 'quote' WHEN contains(line, '~~') AND trim(regexp_replace(line, '~~(.+?)~~', '', 'g')) = '' AND NOT regexp_matches(ltrim(regexp_replace(line, '\\([!-/:-@\[-`{-~])', '\1', 'g'), '*~ '), '^\s*(\d+\.|\d+(\.\d+)+\.?)\s+\S') THEN 'struck' WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 'heading'""" if markdown else ""
    marks = [r"\-", "–", "—", r"\*", "_", *(["~"] if markdown else [])]
    return f"CASE WHEN regexp_matches(line, {_separator(marks)}) THEN 'separator' WHEN {_CLASSED} THEN 'classed' {extra} WHEN regexp_matches(line, '^\\s*[-*+]\\s+\\S') THEN 'bullet' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' ELSE 'paragraph' END"


_BULLET = r"""regexp_replace(regexp_replace(regexp_replace(line, '^\s*[-*+]\s+', ''), '^\[[xX]\]\s+', 'Concluído: '), '^\[ \]\s+', 'Pendente: ')"""
_BLOCK_TEXT = rf"""CASE kind WHEN 'heading' THEN {strip_sql("regexp_replace(line, '^#{1,6}\\s+', '')")} WHEN 'bullet' THEN {_BULLET} WHEN 'quote' THEN regexp_replace(line, '^(>\s?)+', '') WHEN 'struck' THEN replace(line, '~~', '')
 WHEN 'classed' THEN regexp_extract(line, '(?is)^<p\s+class=["''][^"'']+["'']>(.*)</p>$', 1) ELSE line END"""
_BLOCK_LEVEL = r"""CAST(CASE kind WHEN 'heading' THEN least(len(regexp_extract(line, '^(#{1,6})\s', 1)), 4) WHEN 'bullet' THEN least((len(regexp_extract(line, '^(\s*)', 1)) + 1) // 2, 3) END AS INTEGER)"""


@query("markdown_blocks", LINES + f""", l AS (SELECT doc_id, pos, {_MARKED} AS line FROM lines), """ + FENCES.format(source="l") + f""",
k AS (SELECT doc_id, pos, line, CASE WHEN code AND regexp_matches(line, '^`{{3,}}') THEN 'fence' WHEN code THEN 'code' ELSE {_ladder(True)} END AS kind FROM coded)
SELECT doc_id, pos, kind, {_BLOCK_LEVEL} AS level, {_BLOCK_TEXT} AS text FROM k WHERE kind NOT IN ('separator', 'fence')""")
def q_blocks(spark, sf):
    return M.blocks(lines(spark, sf).withColumn("line", F.expr(_MARKED)), "doc_id", "pos", "line")


@query("text_blocks", LINES + f""", l AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN '   * ' || line ELSE line END AS line FROM lines), k AS (SELECT *, {_ladder(False)} AS kind FROM l)
SELECT doc_id, pos, kind, {_BLOCK_LEVEL} AS level, {_BLOCK_TEXT} AS text FROM k WHERE kind <> 'separator'""")
def q_text(spark, sf):
    line = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("   * "), "line")).otherwise(F.col("line"))
    return M.blocks(lines(spark, sf).withColumn("line", line), "doc_id", "pos", "line", markdown=False)


@query("pipe_tables", ALL_LINES + rf""", l AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 3 THEN '| --- | :-: |' WHEN pos % 5 > 1 THEN '| ' || line || ' | a\|b |' ELSE line END AS line FROM lines),
t AS (SELECT *, regexp_matches(line, '^\s*\|.*\|\s*$') AS t FROM l), g AS (SELECT *, pos - sum(t::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM t),
k AS (SELECT *, CAST(min(pos) OVER (PARTITION BY doc_id, g) AS INTEGER) AS "table" FROM g WHERE t),
c AS (SELECT *, list_transform(string_split(replace(regexp_replace(regexp_replace(line, '^\s*\|', ''), '\|\s*$', ''), '\|', chr(1)), '|'), lambda x: replace({strip_sql('x')}, chr(1), '|')) AS cells FROM k)
SELECT doc_id, "table", CAST(row_number() OVER (PARTITION BY doc_id, "table" ORDER BY pos) - 1 AS INTEGER) AS row, array_to_string(cells, ';') AS cells FROM c WHERE len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-+:?$'))) > 0""")
def q_tables(spark, sf):
    k = F.col("pos") % 5
    line = F.when(k == 3, "| --- | :-: |").when(k > 1, F.concat(F.lit("| "), "line", F.lit(" | a\\|b |"))).otherwise(F.col("line"))
    found = M.pipe_tables(all_lines(spark, sf).withColumn("line", line), "doc_id", "pos", "line")
    return found.select("doc_id", "table", "row", F.array_join("cells", ";").alias("cells"))


@query("red_regions", ALL_LINES + """, l AS (SELECT doc_id, pos, CASE pos % 6 WHEN 1 THEN '<red>' || line WHEN 3 THEN line || '</red>' ELSE line END AS line FROM lines), c AS (SELECT *, (len(line) - len(replace(line, '<red>', ''))) // 5 AS o, (len(line) - len(replace(line, '</red>', ''))) // 6 AS c FROM l)
SELECT doc_id, pos, o > 0 OR coalesce(sum(o - c) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS red FROM c""")
def q_red(spark, sf):
    k = F.col("pos") % 6
    line = F.when(k == 1, F.concat(F.lit("<red>"), "line")).when(k == 3, F.concat("line", F.lit("</red>"))).otherwise(F.col("line"))
    return M.red_regions(all_lines(spark, sf).withColumn("line", line), "doc_id", "pos", "line").select("doc_id", "pos", "red")


_LINK = r"\[([^\]]+)\]\((https?://(?:[^()\s]|\([^()\s]*\))+)\)"


@query("residual_links", LINES + rf"""SELECT doc_id, pos, '<p><a href="https://b.example">[x](https://c.example)</a>' || regexp_replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' [y](https://a.example/(1))', '{_LINK}', '<a href="\2">\1</a>', 'g') || '</p>' AS html FROM lines""")
def q_links(spark, sf):
    html = F.concat(F.lit('<p><a href="https://b.example">[x](https://c.example)</a>'), T.escape_html(F.col("line")), F.lit(" [y](https://a.example/(1))</p>"))
    return lines(spark, sf).select("doc_id", "pos", M.link_residues(html).alias("html"))


_IMAGES = "line || ' ![foto *' || pos || '*](a.png) ![ ](b.png)![#x](c) ! [y](z)'"


@query("image_placeholders", LINES + rf""", t AS (SELECT doc_id, pos, regexp_extract_all({_IMAGES}, '(?s)!\[[^\]]*\]\([^)]+\)|[^!]+|!') AS pieces FROM lines)
SELECT doc_id, pos, array_to_string(list_transform(pieces, lambda p: CASE WHEN NOT regexp_matches(p, '(?s)^!\[[^\]]*\]\(.+\)$') THEN p WHEN trim(regexp_extract(p, '(?s)^!\[([^\]]*)\]', 1)) = '' THEN 'Imagem não incorporada (sem descrição)'
 ELSE 'Imagem não incorporada (' || regexp_replace(regexp_replace(trim(regexp_extract(p, '(?s)^!\[([^\]]*)\]', 1)), '([\\*\[\]`~])', '\\\1', 'g'), '^([#>|+*-])', '\\\1') || ')' END), '') AS text FROM t""")
def q_images(spark, sf):
    line = F.concat("line", F.lit(" ![foto *"), F.col("pos").cast("string"), F.lit("*](a.png) ![ ](b.png)![#x](c) ! [y](z)"))
    return lines(spark, sf).select("doc_id", "pos", M.image_placeholders(line).alias("text"))


@query("signature_lines", LINES + rf""", t AS (SELECT doc_id, pos, {strip_sql("line")} AS line, pos % 2 = 0 AND len({words_sql("line")}) > 12 AS long, '[Assinado eletronicamente]' AS mark, CASE WHEN pos % 2 = 0 THEN {strip_sql("line")} ELSE 'Nome' END AS last, line AS raw FROM lines)
SELECT doc_id, pos, unnest(CASE WHEN long THEN [raw || chr(10) || mark || chr(10) || chr(10) || CASE WHEN pos % 2 = 0 THEN raw ELSE 'Nome' END] ELSE [line, mark, last] END) AS part FROM t""")
def q_signature_lines(spark, sf):
    """Every line, then a mark, then a name or the line again: where that is too long for a name, the paragraph stays whole."""
    text = F.concat("line", F.lit("\n[Assinado eletronicamente]\n\n"), F.when(F.col("pos") % 2 == 0, F.col("line")).otherwise("Nome"))
    # an outer one: for a plain one Spark would compute the parts again, and once more, to leave out rows without any
    return lines(spark, sf).select("doc_id", "pos", F.explode_outer(M.signature_lines(text)).alias("part")).where("part is not null")


@query("signature_indices")
def q_indices(spark, sf):
    n = F.size(F.split("line", " "))
    short = F.when(F.col("pos") % 6 == 2, "[assinado eletronicamente]").when(n <= 12, F.col("line"))
    rows = lines(spark, sf).select("doc_id", "pos", (n <= 12).alias("f"), short.alias("s"))
    t = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "f", "s"))).alias("l"))
    return t.select("doc_id", F.array_join(M.signature_indices(F.col("l.f"), F.col("l.s")), ",").alias("at"))


@query("pdf_structure")
def q_pdf(spark, sf):
    k = F.col("pos") % 5
    line = F.when(k == 2, F.concat((F.col("pos") % 30 + 1).cast("string"), F.lit(". DO PEDIDO"))).when(k == 4, "CONCLUSÃO").otherwise(F.trim("line"))
    return M.structured(lines(spark, sf).withColumn("line", line), "doc_id", "pos", "line")



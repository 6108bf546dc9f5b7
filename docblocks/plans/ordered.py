"""Queries of the operators over ordered sequences, and the flagship conversion of text documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docblocks.functions import text as T
from docblocks.operators import ordered as O
from docblocks.operators import reports as G
from docblocks.operators import render
from docblocks.operators import rules as R
from docblocks.plans.registry import ALL_LINES, FENCES, LINES, all_lines, NUMBERED, lines, numbered, query, strip_sql, table, words_sql
from docblocks.plans.text import PROSE


@query("role_runs", "SELECT conv_id, turn, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM (SELECT conv_id, turn, CASE WHEN g IS DISTINCT FROM lag(g) OVER w OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM (SELECT conv_id, turn, length(text) % 3 = 0 AS g FROM conversations) a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) b")
def q_runs(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 3 == 0).alias("g"))
    return O.runs(t, "conv_id", "turn", "g").select("conv_id", "turn", "run")


@query("header_split", NUMBERED + "SELECT doc_id, pos, coalesce(pos < min(CASE WHEN level = 1 AND pos > 3 THEN pos END) OVER (PARTITION BY doc_id), false) AS header FROM numbered")
def q_header(spark, sf):
    return O.split_header(numbered(spark, sf), "doc_id", "pos", (F.col("level") == 1) & (F.col("pos") > 3)).select("doc_id", "pos", "header")


_COUNT = """ n1 AS (SELECT *, CAST(sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS n1 FROM numbered),
n2 AS (SELECT *, CAST(sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n1 ORDER BY pos) AS INTEGER) AS n2 FROM n1),
n3 AS (SELECT *, CAST(sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n1, n2 ORDER BY pos) AS INTEGER) AS n3 FROM n2),
n4 AS (SELECT *, CAST(sum(CASE WHEN level = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n1, n2, n3 ORDER BY pos) AS INTEGER) AS n4 FROM n3)
"""


@query("running_numbers", NUMBERED + "," + _COUNT + "SELECT doc_id, pos, level, n1, n2, n3, n4 FROM n4")
def q_counters(spark, sf):
    return O.counters(numbered(spark, sf), "doc_id", "pos", "level").select("doc_id", "pos", "level", "n1", "n2", "n3", "n4")


@query("level_gaps", NUMBERED + """, steps AS (SELECT doc_id, pos, lv, lag(lv) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM (SELECT doc_id, pos, CASE WHEN level = 0 THEN 0 ELSE CAST((pos * 7 + doc_id) % 4 + 1 AS INTEGER) END AS lv FROM numbered) a WHERE lv > 0)
SELECT doc_id, arg_min(lv, pos) AS first_level, arg_min(prev, pos) FILTER (lv > prev + 1) AS jump_from, arg_min(lv, pos) FILTER (lv > prev + 1) AS jump_to FROM steps GROUP BY doc_id""")
def q_gaps(spark, sf):
    t = numbered(spark, sf).withColumn("lv", F.when(F.col("level") == 0, 0).otherwise(((F.col("pos") * 7 + F.col("doc_id")) % 4 + 1).cast("int")))
    return O.level_faults(t, "doc_id", "pos", "lv")


def _arrays(spark, sf, *cols):
    """One row for each document with its lines in order."""
    listed = F.sort_array(F.collect_list(F.struct("pos", *cols)))
    return lines(spark, sf).groupBy("doc_id").agg(listed.alias("l"))


@query("list_trees", LINES + """, l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, (pos * 5 + doc_id) % 4 AS lv FROM lines),
w AS (WITH RECURSIVE r(doc_id, i, base, lv) AS (SELECT doc_id, i, lv, CAST(0 AS BIGINT) FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, r.base, CAST(greatest(0, least(l.lv - r.base, r.lv + 1)) AS BIGINT) FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1) SELECT * FROM r)
SELECT doc_id, string_agg(lv, ',' ORDER BY i) AS levels FROM w GROUP BY doc_id""")
def q_trees(spark, sf):
    t = _arrays(spark, sf).select("doc_id", F.transform("l.pos", lambda p: ((p * 5 + F.col("doc_id")) % 4).cast("int")).alias("levels"))
    return t.select("doc_id", F.array_join(O.list_levels(F.col("levels")), ",").alias("levels"))


@query("code_fences", ALL_LINES + """, l AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 1 THEN repeat('`', 3 + CAST(pos % 2 AS INTEGER)) ELSE line END AS line FROM lines), """ + FENCES.format(source="l") + "SELECT doc_id, pos, code FROM coded")
def q_fences(spark, sf):
    """Every line, with fences of three and four marks between them."""
    fence = F.when(F.col("pos") % 2 == 0, "```").otherwise("````")
    t = all_lines(spark, sf).withColumn("line", F.when(F.col("pos") % 5 == 1, fence).otherwise(F.col("line")))
    t = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    t = t.withColumn("code", O.fence_blocks(F.col("l.line")))
    return t.select("doc_id", F.explode(F.arrays_zip(F.col("l.pos").alias("pos"), "code")).alias("z")).select("doc_id", "z.pos", "z.code")


@query("signature_tail", None)
def q_signature(spark, sf):
    n = F.size(F.split("line", " "))
    mark = F.when(F.col("pos") % 6 == 5, "[assinado eletronicamente]").otherwise(F.col("line"))
    rows = lines(spark, sf).select("doc_id", "pos", (n <= 12).alias("flag"), F.when(n <= 12, mark).alias("short"))
    t = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "flag", "short"))).alias("l"))
    return t.select("doc_id", O.signature_tail(F.col("l.flag"), F.col("l.short")).alias("lines"))


@query("signature_centred", LINES + f""", f AS (SELECT doc_id, pos, len({words_sql('line')}) <= 12 AS flag FROM lines), b AS (SELECT doc_id, count(*) AS total, coalesce(max(CASE WHEN NOT flag THEN pos END), -1) AS last FROM f GROUP BY doc_id),
t AS (SELECT f.doc_id, count(*) FILTER (pos > last) AS n, any_value(total) AS total FROM f JOIN b USING (doc_id) GROUP BY f.doc_id)
SELECT doc_id, CAST(CASE WHEN n = total OR n < 2 THEN 0 ELSE n END AS INTEGER) AS lines FROM t""")
def q_signature_centred(spark, sf):
    rows = lines(spark, sf).select("doc_id", "pos", (F.size(T.words(F.col("line"))) <= 12).alias("flag"))
    t = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "flag"))).alias("l"))
    none = F.transform("l.flag", lambda _: F.lit(None).cast("string"))
    return t.select("doc_id", O.signature_tail(F.col("l.flag"), none).alias("lines"))


@query("signature_blocks", None)
def q_signature_blocks(spark, sf):
    t = lines(spark, sf).select("doc_id", "pos", (F.col("pos") % 7 > 2).alias("signed"), F.when(F.col("pos") % 3 == 0, "Assinado eletronicamente").otherwise(F.col("line")).alias("text"))
    return O.spread_signatures(t, "doc_id", "pos", "signed", "text")


_AFTER = r"'^[\s.,;:]*(\([^()]*\)[\s.,;:]*)?$'"


@query("quoted_spans", LINES + f""", l AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, CASE pos % 5 WHEN 1 THEN '“' || line WHEN 3 THEN line || '” (art. 1).' WHEN 4 THEN NULL ELSE line END AS raw FROM lines),
t AS (SELECT *, {strip_sql('raw')} AS t FROM l), o AS (SELECT *, t[1] AS o, CASE t[1] WHEN '"' THEN '"' WHEN '“' THEN '”' WHEN '«' THEN '»' END AS c, t[2:] AS rest FROM t WHERE t[1] IN ('"', '“', '«')),
single AS (SELECT doc_id, i AS a, i AS b FROM o WHERE contains(rest, c) AND len(string_split(rest, c)) = 2 AND regexp_matches(string_split(rest, c)[2], {_AFTER}) AND (contains({strip_sql('string_split(rest, c)[1]')}, chr(10)) OR len({strip_sql('string_split(rest, c)[1]')}) >= 100)),
ends AS (SELECT o.doc_id, o.i AS a, o.c, o.o, min(t.i) AS b FROM o JOIN t ON t.doc_id = o.doc_id AND t.i > o.i AND NOT contains(o.rest, o.c) AND (t.t IS NULL OR contains(CASE WHEN starts_with(t.t, o.o) THEN t.t[2:] ELSE t.t END, o.c)) GROUP BY 1, 2, 3, 4),
body AS (SELECT e.doc_id, e.a, e.b, e.c, CASE WHEN starts_with(t.t, e.o) THEN t.t[2:] ELSE t.t END AS body FROM ends e JOIN t ON t.doc_id = e.doc_id AND t.i = e.b WHERE t.t IS NOT NULL),
found AS (SELECT * FROM single UNION ALL SELECT doc_id, a, b FROM body WHERE len(string_split(body, c)) = 2 AND regexp_matches(string_split(body, c)[2], {_AFTER})),
spans AS (WITH RECURSIVE s(doc_id, a, b) AS (SELECT doc_id, min(a), arg_min(b, a) FROM found GROUP BY doc_id UNION ALL
 SELECT doc_id, a, b FROM (SELECT s.doc_id, min(f.a) AS a, arg_min(f.b, f.a) AS b FROM s JOIN found f ON f.doc_id = s.doc_id AND f.a > s.b GROUP BY s.doc_id) n) SELECT * FROM s)
SELECT t.doc_id, t.pos FROM t JOIN spans s ON s.doc_id = t.doc_id AND t.i BETWEEN s.a AND s.b""")
def q_quoted(spark, sf):
    """Every line; some open a quotation, some close one, some are tables."""
    k = F.col("pos") % 5
    text = F.when(k == 1, F.concat(F.lit("“"), "line")).when(k == 3, F.concat("line", F.lit("” (art. 1)."))).when(k == 4, F.lit(None).cast("string")).otherwise(F.col("line"))
    t = lines(spark, sf).select("doc_id", "pos", text.alias("t")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("l"))
    t = t.withColumn("at", O.quoted_spans(F.col("l.t")))
    return t.select("doc_id", F.explode(F.transform("at", lambda i: F.get(F.col("l.pos"), i))).alias("pos"))


@query("number_glue", LINES + """, n AS (SELECT doc_id, pos, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS n FROM lines) SELECT doc_id, n, '1.' || (pos % 30) || '. ' || line AS line FROM n""")
def q_glue(spark, sf):
    """Before every line the pieces of a number, a blank among them."""
    t = lines(spark, sf).select("doc_id", "pos", F.posexplode(F.array(F.lit("1"), F.lit("."), (F.col("pos") % 30).cast("string"), F.lit("."), F.lit(""), F.col("line"))).alias("k", "x"))
    t = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "x"))).alias("l"))
    return t.select("doc_id", F.posexplode(O.glue_numbers(F.col("l.x"))).alias("n", "line"))


_HEADING = r"(len(line) BETWEEN 3 AND 60 AND regexp_matches(line, '^\p{Lu}[\p{Lu}\s.-]*$'))"


@query("regrouped", ALL_LINES + rf""", k AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 2 THEN (pos % 30 + 1) || '. ' || trim(line) WHEN pos % 7 = 5 THEN '' ELSE trim(line) END AS line FROM lines),
i AS (SELECT *, regexp_matches(line, '^\d{{1,2}}(\.\d{{1,2}})*\.\s+\S.*$') AS item, line = '' AS blank FROM k), h AS (SELECT *, coalesce(max((item OR blank)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AND NOT item AND NOT blank AS header FROM i),
a AS (SELECT *, header OR (NOT item AND {_HEADING}) AS alone FROM h), g AS (SELECT *, sum((alone OR item OR before)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (SELECT *, coalesce(lag(alone OR blank) OVER (PARTITION BY doc_id ORDER BY pos), true) AS before FROM a) b)
SELECT doc_id, min(pos) AS first, CASE WHEN bool_or(header) THEN 'cabecalho' ELSE 'corpo' END AS kind, CASE WHEN bool_or(header) THEN arg_min(line, pos) ELSE {strip_sql("regexp_replace(string_agg(line, ' ' ORDER BY pos), '[\\s\\x{00A0}]+', ' ', 'g')")} END AS text FROM g WHERE NOT blank GROUP BY doc_id, g""")
def q_regroup(spark, sf):
    bare = F.trim("line")
    t = all_lines(spark, sf).withColumn("line", F.when(F.col("pos") % 4 == 2, F.concat((F.col("pos") % 30 + 1).cast("string"), F.lit(". "), bare)).when(F.col("pos") % 7 == 5, "").otherwise(bare))
    return O.regroup(t, "doc_id", "pos", "line")


@query("list_counters", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(last_value(CASE WHEN e IS NOT NULL THEN e - n END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY n), 0) + n AS INTEGER) AS number FROM
 (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN CAST(l_suppkey % 50 AS INTEGER) END AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber * 1000000 + l_partkey * 100 + l_suppkey) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)) AS n FROM lineitem) x""")
def q_list_counters(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 5 == 0, (F.col("l_suppkey") % 50).cast("int")).alias("e"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")) * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"))
    return O.list_counter(t, "l_orderkey", "p", "e").select("l_orderkey", "l_linenumber", "l_partkey", "number")


@query("blank_squeeze", "SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def q_squeeze(spark, sf):
    return table(spark, sf, "documents").select("doc_id", G.squeeze_blank_lines(F.replace("text", F.lit("\n"), F.lit("\n\n\n"))).alias("text"))


def convert_lines(rows):
    """Text paragraphs to classed blocks: (doc_id, pos, class, html). The document's convention, a window over its lines, decides the numbered families."""
    rows = rows.withColumn("depth", T.item_depth(F.col("line")))
    rows = R.with_convention(rows, "doc_id", F.col("depth"), F.when(F.col("depth") == 1, T.is_prose(F.col("line"))))
    none = lambda kind: F.lit(None).cast(kind)
    caps = F.when(F.col("depth") == 0, F.when(T.is_caps(F.col("line")), "Texto_Centralizado_Maiusculas"))
    name = R.paragraph_class(none("string"), F.col("depth"), F.col("convention"), none("string"), F.lit(0), F.lit(1), caps, F.lit(False), F.lit(False), F.lit(False), none("string"), none("double"), named=none("string"))
    named = rows.withColumn("class", name)
    body = T.strip_number(F.col("line"), F.col("class"))
    return named.select("doc_id", "pos", "class", render.block(F.col("class"), T.escape_html(T.strip(body))).alias("html"))


_BLOCKS = NUMBERED + ", " + PROSE + r""", votes AS (SELECT doc_id, count(*) FILTER (level = 1 AND prose) > count(*) FILTER (level = 1 AND NOT prose) AS paragraphs FROM prose GROUP BY doc_id),
named AS (SELECT n.doc_id, pos, line, CASE WHEN level > 0 AND paragraphs THEN CASE WHEN level <= 3 THEN 'Paragrafo_Numerado_Nivel' || level ELSE 'Item_Alinea_Letra' END WHEN level > 0 THEN 'Item_Nivel' || level
 WHEN NOT contains(line, 'ß') AND len(c) >= 3 AND len(list_filter(c, lambda x: x <> upper(x))) = 0 THEN 'Texto_Centralizado_Maiusculas' ELSE 'Texto_Justificado' END AS class
 FROM (SELECT *, list_filter(string_split(line, ''), lambda x: lower(x) <> upper(x)) AS c FROM numbered) n JOIN votes USING (doc_id)),
blocks AS (SELECT doc_id, pos, class, '<p class="' || class || '">' || replace(replace(replace(trim(CASE WHEN class = 'Item_Alinea_Letra' OR class LIKE 'Item_Nivel%' OR class LIKE 'Paragrafo_Numerado%' THEN regexp_replace(line, '^\s*\d+(\.\d+)*\.?\s*[-–—]?\s+', '') ELSE line END), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' AS html FROM named)
"""


@query("block_html", _BLOCKS + "SELECT doc_id, string_agg(html, chr(10) ORDER BY pos) AS html FROM blocks GROUP BY doc_id")
def q_block_html(spark, sf):
    return render.joined_blocks(convert_lines(numbered(spark, sf)), "doc_id", "pos", "html")


@query("block_classes", _BLOCKS + "SELECT class, count(*) AS n FROM blocks GROUP BY class")
def q_block_classes(spark, sf):
    return convert_lines(numbered(spark, sf)).groupBy("class").agg(F.count("*").alias("n"))


_HEAD = """'<!DOCTYPE html>' || chr(10) || '<html lang="pt-BR">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>Conteúdo formatado para o SEI</title>' || chr(10) || '<style>' || chr(10) || chr(10)
 || 'body::before { content: ""; counter-reset: item-n1 0 item-n2 0 item-n3 0 item-n4 0 paragrafo-n1 0 paragrafo-n2 0 paragrafo-n3 0 romano_maiusculo 0 letra_minuscula 0; }' || chr(10) || '</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)"""


@query("html_documents", _BLOCKS + f"SELECT doc_id, {_HEAD} || string_agg(html, chr(10) ORDER BY pos) || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM blocks GROUP BY doc_id")
def q_documents(spark, sf):
    return q_block_html(spark, sf).select("doc_id", render.html_document(F.col("html")).alias("html"))


@query("result_json", _BLOCKS + """SELECT doc_id, 'doc' || doc_id || '.md' AS nome, true AS sucesso, 'doc' || doc_id || '_SEI.html' AS arquivo, string_agg(html, chr(10) ORDER BY pos) AS conteudo FROM blocks GROUP BY doc_id""")
def q_json(spark, sf):
    """Results as JSON, read again by their fields."""
    empty = F.array().cast("array<string>")
    files = F.array(F.struct(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_SEI.html")).alias("nome"), F.col("html").alias("conteudo")))
    made = q_block_html(spark, sf).select("doc_id", render.result_json(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")), F.lit(True), empty, empty, files).alias("json"))
    read = F.from_json("json", "nome_origem string, sucesso boolean, erros array<string>, avisos array<string>, arquivos array<struct<nome:string,conteudo:string>>")
    return made.select("doc_id", read.alias("j")).select("doc_id", F.col("j.nome_origem").alias("nome"), "j.sucesso", F.get("j.arquivos", F.lit(0))["nome"].alias("arquivo"), F.get("j.arquivos", F.lit(0))["conteudo"].alias("conteudo"))

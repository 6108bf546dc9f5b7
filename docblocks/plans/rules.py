"""Queries of predicates, lookup joins, votes and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import text as T
from docblocks.operators import lookups as L
from docblocks.operators import reports as G
from docblocks.operators import rules as R
from docblocks.plans.registry import LINES, NUMBERED, lines, numbered, placed, query, table, words_sql
from docblocks.plans.text import PROSE

_CLASS_LIST = ", ".join(f"('{c}')" for c in S.CLASSES)


@query("class_catalogue", f"SELECT class_name, CASE WHEN regexp_matches(class_name, 'Nivel[1-4]$') THEN CAST(right(class_name, 1) AS INTEGER) END AS level, count(n) AS parts FROM (VALUES {_CLASS_LIST}) t(class_name) LEFT JOIN (SELECT CASE p_size % 3 WHEN 0 THEN 'Item_Nivel' || (p_partkey % 6) WHEN 1 THEN 'Texto_Justificado' END AS n FROM part) p ON n = class_name GROUP BY 1, 2")
def q_catalogue(spark, sf):
    """Every class of the catalogue, and how many parts have a style of its name."""
    rows = spark.createDataFrame([(c,) for c in S.CLASSES], "class_name string")
    used = table(spark, sf, "part").select(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Item Nivel"), (F.col("p_partkey") % 6).cast("string"))).when(F.col("p_size") % 3 == 1, "Texto Justificado").alias("style"))
    used = used.select(R.class_from_style(F.col("style")).alias("class_name")).where("class_name is not null").groupBy("class_name").agg(F.count("*").alias("n"))
    level = F.regexp_extract("class_name", "Nivel([1-4])$", 1)
    return rows.join(F.broadcast(used), "class_name", "left").select("class_name", F.when(level != "", level.cast("int")).alias("level"), F.coalesce("n", F.lit(0)).alias("parts"))


_STYLE = "CASE p_size % 5 WHEN 0 THEN 'Texto Justificado' WHEN 1 THEN 'Item_Nivel' || (p_partkey % 6) WHEN 2 THEN 'Heading ' || (p_partkey % 7 + 1) WHEN 3 THEN p_brand ELSE 'Citação' END"


@query("class_names", f"SELECT p_partkey, style, CASE WHEN style IN (SELECT * FROM (VALUES {_CLASS_LIST}) t(c)) THEN style WHEN replace(style, ' ', '_') IN (SELECT * FROM (VALUES {_CLASS_LIST}) t(c)) THEN replace(style, ' ', '_') END AS class FROM (SELECT p_partkey, {_STYLE} AS style FROM part) x")
def q_class_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(_STYLE).alias("style")).withColumn("class", R.class_from_style(F.col("style")))


@query("unknown_classes", f"SELECT p_partkey, array_to_string(list_sort(list_filter([{_STYLE}, 'Tachado', 'x' || p_size], lambda s: NOT list_contains([{', '.join(repr(c) for c in S.CLASSES)}], s))), ';') AS unknown FROM part")
def q_unknown(spark, sf):
    used = F.array(F.expr(_STYLE), F.lit("Tachado"), F.concat(F.lit("x"), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(G.unknown_classes(used), ";").alias("unknown"))


@query("used_classes", f"SELECT p_brand, array_to_string(list_sort(list_distinct(list({_STYLE}))), ';') AS used FROM part GROUP BY p_brand")
def q_used(spark, sf):
    html = F.array_join(F.collect_list(F.concat(F.lit('<p class="'), F.expr(_STYLE), F.lit('">x</p>'))), "")
    return table(spark, sf, "part").groupBy("p_brand").agg(html.alias("html")).select("p_brand", F.array_join(G.used_classes(F.col("html")), ";").alias("used"))


_FORMAT = "l_quantity % 7 = 0 AS strike, l_quantity % 3 = 0 AS grey, l_quantity % 5 = 0 AS spaced, l_linenumber % 2 = 0 AS bold, CASE l_suppkey % 4 WHEN 0 THEN 'center' WHEN 1 THEN 'right' WHEN 2 THEN 'left' END AS align, l_partkey % 2 = 0 AS caps"


@query("class_by_format", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN strike THEN 'Tachado' WHEN grey AND bold THEN CASE WHEN caps THEN 'Texto_Fundo_Cinza_Maiusculas_Negrito' ELSE 'Texto_Fundo_Cinza_Negrito' END
 WHEN spaced AND bold THEN 'Texto_Espaco_Duplo_Recuo_Primeira_Linha' WHEN align = 'center' AND caps THEN CASE WHEN bold THEN 'Texto_Centralizado_Maiusculas_Negrito' ELSE 'Texto_Centralizado_Maiusculas' END END AS class
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_FORMAT} FROM lineitem) x""")
def q_by_format(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", *[e.strip() for e in _split(_FORMAT)])
    return t.select("l_orderkey", "l_linenumber", "l_partkey", R.class_from_format(*[F.col(c) for c in ("strike", "grey", "spaced", "bold", "align", "caps")]).alias("class"))


def _split(expressions: str) -> list[str]:
    return expressions.split(", ")


@query("cell_classes", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN size <= 10 AND (first OR align = 'center') THEN 'Tabela_Texto_10' WHEN size <= 8 AND (align IS NULL OR align IN ('left', 'justify')) THEN 'Tabela_Texto_8' WHEN first OR align = 'center' THEN 'Tabela_Texto_Centralizado'
 WHEN align = 'right' THEN 'Tabela_Texto_Alinhado_Direita' ELSE 'Tabela_Texto_Alinhado_Esquerda' END AS class FROM
 (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 45 THEN l_quantity / 4 + 6 END AS size, CASE l_suppkey % 4 WHEN 0 THEN 'center' WHEN 1 THEN 'right' WHEN 2 THEN 'left' END AS align, l_linenumber = 1 AS first FROM lineitem) a""")
def q_cells(spark, sf):
    align = F.when(F.col("l_suppkey") % 4 == 0, "center").when(F.col("l_suppkey") % 4 == 1, "right").when(F.col("l_suppkey") % 4 == 2, "left")
    size = F.when(F.col("l_quantity") < 45, F.col("l_quantity") / 4 + 6)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.class_from_cell(size, align, F.col("l_linenumber") == 1).alias("class"))


@query("numbering_convention", NUMBERED + ", " + PROSE + """SELECT doc_id, CASE WHEN count(*) FILTER (level = 1 AND prose) > count(*) FILTER (level = 1 AND NOT prose) THEN 'paragrafos' ELSE 'titulos' END AS convention FROM prose GROUP BY doc_id""")
def q_convention(spark, sf):
    rows = numbered(spark, sf)
    return R.convention(rows, "doc_id", T.item_depth(F.col("line")), T.is_prose(F.col("line")))


@query("body_font", """SELECT l_orderkey, arg_max(size, w * 10000000 - p) AS body_size FROM (SELECT l_orderkey, CAST(l_quantity % 5 + 8 AS INTEGER) AS size, CAST(sum(l_partkey % 7) AS BIGINT) AS w, min(l_linenumber * 100000 + l_partkey) AS p FROM lineitem WHERE l_partkey % 7 > 0 AND l_suppkey % 9 > 0 GROUP BY 1, 2) x GROUP BY l_orderkey""")
def q_body_font(spark, sf):
    t = placed(spark, sf, "lineitem").where("l_suppkey % 9 > 0")
    t = t.select("l_orderkey", F.rint(F.col("l_quantity") % 5 + 8).cast("int").alias("size"), (F.col("l_partkey") % 7).alias("chars"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"), "seen")
    return R.body_size(t, "l_orderkey", "size", "chars", "pos", "seen")


@query("max_unless_unknown", "SELECT l_orderkey, CASE WHEN count(*) = count(s) THEN max(s) END AS size FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 9 > 0 THEN l_quantity END AS s FROM lineitem) x GROUP BY l_orderkey")
def q_max(spark, sf):
    size = F.when(F.col("l_suppkey") % 9 > 0, F.col("l_quantity"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(R.max_unless_unknown(size).alias("size"))


@query("paragraph_format", "SELECT o_orderkey, coalesce(bool_and(l_returnflag = 'N'), false) AS bold, coalesce(bool_and(l_quantity > 10), false) AS caps FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 2 GROUP BY o_orderkey")
def q_par_format(spark, sf):
    runs = table(spark, sf, "lineitem").where("l_quantity > 2").withColumnRenamed("l_orderkey", "o_orderkey")
    return G.paragraph_format(table(spark, sf, "orders"), runs, "o_orderkey", {"bold": F.col("l_returnflag") == "N", "caps": F.col("l_quantity") > 10})


@query("quotation_counts", LINES + f"""SELECT doc_id, count(*) FILTER (pos % 3 = 0) AS by_indent, count(*) FILTER (pos % 3 = 1) AS by_marks,
 string_agg(array_to_string(list_slice({words_sql('line')}, 1, 12), ' ') || CASE WHEN len({words_sql('line')}) > 12 THEN '…' ELSE '' END, chr(10) ORDER BY pos) FILTER (pos % 3 < 2) AS excerpts FROM lines GROUP BY doc_id""")
def q_quotes(spark, sf):
    kind = F.col("pos") % 3
    out = G.quotation_counts(lines(spark, sf), "doc_id", "pos", "line", kind == 0, kind == 1)
    return out.withColumn("excerpts", F.when(F.size("excerpts") > 0, F.array_join("excerpts", "\n")))


@query("style_chain", """WITH RECURSIVE s AS (SELECT c_custkey AS k, c_custkey * 3 % 1500 + 1 AS p, CASE WHEN c_nationkey % 8 = 0 THEN c_mktsegment END AS v FROM customer),
 chain(k, steps, p, v) AS (SELECT k, 0, p, v FROM s UNION ALL SELECT c.k, c.steps + 1, s.p, s.v FROM chain c JOIN s ON c.p = s.k WHERE c.steps < 10 AND c.v IS NULL)
 SELECT k, arg_min(v, steps) FILTER (v IS NOT NULL) AS v, min(steps) FILTER (v IS NOT NULL) AS steps FROM chain GROUP BY k""")
def q_chain(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 3 % 1500 + 1).alias("p"), F.when(F.col("c_nationkey") % 8 == 0, F.col("c_mktsegment")).alias("v"))
    return R.inherited(t, "k", "p", "v")


@query("numbering_lookup", """SELECT o_orderkey, num_id, ilvl, CASE WHEN num_id > 0 THEN coalesce(format, 'decimal') END AS num_format FROM (SELECT o_orderkey, CAST(o_custkey % 40 AS INTEGER) AS num_id, CAST(o_orderkey % 4 AS INTEGER) AS ilvl FROM orders) p
 LEFT JOIN (SELECT n_nationkey AS num_id, n_regionkey AS abstract_id FROM nation) n USING (num_id) LEFT JOIN (SELECT r_regionkey AS abstract_id, i AS ilvl, ['decimal', 'lowerLetter', 'upperRoman', 'bullet'][(r_regionkey + i) % 4 + 1] AS format FROM region, (VALUES (0), (1), (2)) t(i)) l USING (abstract_id, ilvl)""")
def q_numbering(spark, sf):
    paragraphs = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).cast("int").alias("num_id"), (F.col("o_orderkey") % 4).cast("int").alias("ilvl"))
    nums = table(spark, sf, "nation").select(F.col("n_nationkey").alias("num_id"), F.col("n_regionkey").alias("abstract_id"))
    levels = table(spark, sf, "region").select(F.col("r_regionkey").alias("abstract_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ilvl"))
    levels = levels.withColumn("format", F.element_at(F.array(*[F.lit(x) for x in ("decimal", "lowerLetter", "upperRoman", "bullet")]), (F.col("abstract_id") + F.col("ilvl")) % 4 + 1))
    return R.numbering(paragraphs, nums, levels).select("o_orderkey", "num_id", "ilvl", "num_format")


@query("bullet_levels", "SELECT p_partkey, style, CAST(greatest(0, least(3, CASE WHEN d = '' THEN 0 ELSE CAST(d AS INTEGER) - 1 END)) AS INTEGER) AS level FROM (SELECT *, regexp_extract(style, '(\\d+)', 1) AS d FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'List Bullet' ELSE 'List Bullet ' || (p_size % 7) END AS style FROM part) a) b")
def q_bullets(spark, sf):
    style = F.when(F.col("p_size") % 3 == 0, "List Bullet").otherwise(F.concat(F.lit("List Bullet "), (F.col("p_size") % 7).cast("string")))
    return table(spark, sf, "part").select("p_partkey", style.alias("style")).withColumn("level", L.bullet_level(F.col("style")))


@query("note_references", """SELECT doc_id, note, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY p) AS INTEGER) AS number, label FROM (SELECT doc_id, note, min(pos) AS p FROM (SELECT o_custkey AS doc_id, CAST(o_orderkey % 11 AS INTEGER) AS note, o_orderkey AS pos FROM orders) r GROUP BY 1, 2) f
 JOIN (SELECT n_nationkey AS k, n_name AS label FROM nation WHERE n_nationkey < 9) n ON n.k = f.note""")
def q_notes(spark, sf):
    refs = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 11).cast("int").alias("note"), F.col("o_orderkey").alias("pos"))
    notes = table(spark, sf, "nation").where("n_nationkey < 9").select(F.col("n_nationkey").alias("note"), F.col("n_name").alias("label"))
    return L.numbered_notes(refs, notes).select("doc_id", "note", "number", "label")


@query("flagged_paragraphs", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS signed FROM orders")
def q_flagged(spark, sf):
    marked = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.flagged(table(spark, sf, "orders"), marked, ["o_orderkey"], "signed").select("o_orderkey", "signed")


@query("span_formats", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_size > 25, false) AS bold, coalesce(p_size % 2 = 0, false) AS italic FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 > 0) p ON p_partkey = l_partkey")
def q_spans(spark, sf):
    known = table(spark, sf, "part").where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 25).alias("bold"), (F.col("p_size") % 2 == 0).alias("italic"))
    return L.span_formats(table(spark, sf, "lineitem"), known, "l_partkey", ["bold", "italic"]).select("l_orderkey", "l_linenumber", "l_partkey", "bold", "italic")


@query("relationships", "SELECT o_orderkey, c_name AS target FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def q_rels(spark, sf):
    rels = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("target"))
    return L.targets(table(spark, sf, "orders"), rels, "o_custkey").select("o_orderkey", "target")


_SAID = """SELECT c_custkey, coalesce(i, 0) AS i, coalesce(m, 0) AS m, c_nationkey % 2 = 0 AS applied FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderkey % 7 = 0) AS i, count(*) FILTER (o_orderkey % 5 = 0) AS m FROM orders GROUP BY 1) o ON o_custkey = c_custkey"""


@query("report_sentences", f"""SELECT c_custkey, i, m, CASE WHEN i + m = 0 THEN NULL WHEN i + m = 1 AND m = 0 THEN '1 parágrafo recuado e em fonte menor que a do texto ' WHEN i + m = 1 THEN '1 parágrafo entre aspas com mais de uma linha '
 WHEN m = 0 THEN i || ' parágrafos recuados e em fonte menor que a do texto ' WHEN i = 0 THEN m || ' parágrafos em citações entre aspas com mais de uma linha ' ELSE (i + m) || ' parágrafos (' || i || ' recuados e em fonte menor, ' || m || ' entre aspas) ' END ||
 CASE WHEN i + m = 1 THEN CASE WHEN applied THEN 'foi convertido como Citação.' ELSE 'parece citação e saiu como texto comum. Para convertê-lo, use --citacao-por-recuo.' END WHEN applied THEN 'foram convertidos como Citação.' ELSE 'parecem citação e saíram como texto comum. Para convertê-los, use --citacao-por-recuo.' END AS quotations,
 CASE WHEN applied THEN CASE WHEN m = 0 THEN 'Nenhum parágrafo foi omitido: o documento não tem item 1 depois de um cabeçalho.' WHEN m = 1 THEN '1 parágrafo antes do item 1 foi omitido.' ELSE m || ' parágrafos antes do item 1 foram omitidos.' END END AS header FROM ({_SAID}) x""")
def q_sentences(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderkey") % 7 == 0).alias("i"), F.count_if(F.col("o_orderkey") % 5 == 0).alias("m"))
    t = table(spark, sf, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left")
    t = t.select("c_custkey", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("m", F.lit(0)).alias("m"), (F.col("c_nationkey") % 2 == 0).alias("applied"))
    return t.select("c_custkey", "i", "m", G.quotation_sentence(F.col("i"), F.col("m"), F.col("applied")).alias("quotations"), G.header_sentence(F.col("m"), F.col("applied")).alias("header"))


_LADDER = """CASE WHEN style IN ({cls}) THEN style WHEN replace(style, ' ', '_') IN ({cls}) THEN replace(style, ' ', '_') WHEN signed THEN 'Tabela_Texto_Centralizado' WHEN quoted AND coalesce(align, '') NOT IN ('center', 'right') THEN 'Citação'
 WHEN depth > 0 AND conv = 'paragrafos' THEN CASE WHEN depth <= 3 THEN 'Paragrafo_Numerado_Nivel' || depth ELSE 'Item_Alinea_Letra' END WHEN depth > 0 THEN 'Item_Nivel' || depth
 WHEN style LIKE 'Heading %' THEN 'Item_Nivel' || least(CAST(substr(style, 9, 1) AS INTEGER), 4) WHEN fmt = 'lowerLetter' THEN 'Item_Alinea_Letra' WHEN fmt = 'upperRoman' THEN 'Item_Inciso_Romano' WHEN fmt = 'bullet' THEN 'marcador'
 WHEN fmt IS NOT NULL THEN CASE WHEN conv = 'paragrafos' THEN 'Paragrafo_Numerado_Nivel' || least(greatest(1, least(4, 1 + lvl)), 3) ELSE 'Item_Nivel' || greatest(1, least(4, 1 + lvl)) END
 WHEN strike THEN 'Tachado' WHEN indented THEN 'Citação' WHEN align = 'center' THEN 'Texto_Centralizado' WHEN align = 'right' THEN 'Texto_Alinhado_Direita' WHEN align = 'left' THEN 'Texto_Alinhado_Esquerda' WHEN pt > 8 THEN 'Texto_Justificado_Recuo_Primeira_Linha' ELSE 'Texto_Justificado' END"""
_FACTS = f"""l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 6 = 0 THEN 'Texto Ementa' WHEN l_partkey % 6 = 1 THEN 'Heading ' || (l_linenumber % 6 + 1) ELSE 'Normal' END AS style, l_partkey % 31 = 2 AS signed, l_partkey % 17 = 3 AS quoted,
 CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_linenumber % 4 + 1 AS INTEGER) ELSE 0 END AS depth, CASE WHEN l_orderkey % 2 = 0 THEN 'paragrafos' ELSE 'titulos' END AS conv, CASE l_suppkey % 9 WHEN 1 THEN 'lowerLetter' WHEN 2 THEN 'upperRoman' WHEN 4 THEN 'bullet' WHEN 5 THEN 'decimal' END AS fmt,
 CAST(l_linenumber % 5 AS INTEGER) AS lvl, l_partkey % 13 = 5 AS strike, l_quantity > 48 AS indented, CASE CAST(l_quantity AS INTEGER) % 5 WHEN 0 THEN 'center' WHEN 1 THEN 'right' WHEN 2 THEN 'left' END AS align, l_quantity / 3 AS pt"""


@query("paragraph_classes", "SELECT l_orderkey, l_linenumber, l_partkey, " + _LADDER.format(cls=", ".join(f"'{c}'" for c in S.CLASSES)) + f" AS class FROM (SELECT {_FACTS} FROM lineitem) x")
def q_ladder(spark, sf):
    t = spark.sql(f"SELECT {_FACTS} FROM {{lineitem}}", lineitem=table(spark, sf, "lineitem"))
    c = F.col
    by_format = F.when(c("strike"), "Tachado")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", R.paragraph_class(c("style"), c("depth"), c("conv"), c("fmt"), c("lvl"), F.lit(1), by_format, c("quoted"), c("signed"), c("indented"), c("align"), c("pt")).alias("class"))


@query("indent_quotes", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(indent >= 2.0 AND size < 12, false) AND (align IS NULL OR align = 'left') AS quote FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 10 AS indent, CASE WHEN l_suppkey % 9 > 0 THEN l_suppkey % 9 + 6 END AS size, CASE l_suppkey % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'left' END AS align FROM lineitem) x")
def q_indent(spark, sf):
    k = F.col("l_suppkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.is_indented_quote(F.col("l_quantity") / 10, F.when(k % 9 > 0, k % 9 + 6), F.lit(12), F.when(k % 3 == 0, "center").when(k % 3 == 1, "left")).alias("quote"))


_FILES = "CASE WHEN c_custkey % 2 = 0 THEN 'in/' ELSE 'IN/' END || 'nota' || (c_custkey % 300)"


@query("output_collisions", f"SELECT c_custkey, target, row_number() OVER (PARTITION BY lower(target) ORDER BY c_custkey) = 1 AS written FROM (SELECT c_custkey, {_FILES} || '_SEI.html' AS target FROM customer) x")
def q_collisions(spark, sf):
    from docblocks.operators.render import first_per_target

    t = table(spark, sf, "customer").select("c_custkey", F.concat(F.expr(_FILES), F.lit("_SEI.html")).alias("target"))
    return first_per_target(t, "target", "c_custkey")


@query("duplicate_names", "SELECT c_custkey, CASE WHEN n = 1 THEN name ELSE name || ' (' || n || ')' END AS name FROM (SELECT c_custkey, c_mktsegment AS name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) x")
def q_duplicates(spark, sf):
    from docblocks.operators.render import numbered_duplicates

    return numbered_duplicates(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("name")), "name", "c_custkey")


@query("batch_report", "SELECT l_returnflag, count(*) AS documents, count(*) FILTER (l_quantity > 10) AS converted, CAST(sum(CASE WHEN l_linenumber > 3 THEN l_linenumber ELSE 0 END) AS BIGINT) AS quotations, count(*) FILTER (l_linenumber > 3) AS with_quotations FROM lineitem GROUP BY l_returnflag")
def q_report(spark, sf):
    return G.batch_totals(table(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_quantity") > 10, F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).otherwise(0))


@query("supported_suffixes", """SELECT suffix, suffix IN ('.docx','.pdf','.md','.txt','.odt','.html','.htm') AS supported, suffix IN ('.rtf','.doc') AS retired, count(*) AS pages FROM (SELECT lower(['.docx','.PDF','.md','.Txt','.odt','.html','.HTM','.rtf','.doc','.png',''][page_id % 11 + 1]) AS suffix FROM pages) n GROUP BY 1""")
def q_suffixes(spark, sf):
    """What a scan makes of the suffixes of files named after pages."""
    endings = F.array(*[F.lit(x) for x in (".docx", ".PDF", ".md", ".Txt", ".odt", ".html", ".HTM", ".rtf", ".doc", ".png", "")])
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.get(endings, (F.col("page_id") % 11).cast("int")))
    kind = table(spark, sf, "pages").select(T.suffix(name).alias("suffix"))
    return kind.groupBy("suffix").agg(F.count("*").alias("pages")).select("suffix", F.col("suffix").isin(S.SUPPORTED).alias("supported"), F.col("suffix").isin(S.RETIRED).alias("retired"), "pages")


@query("top_excerpts", LINES + "SELECT doc_id, array_to_string(list_slice(list(pos ORDER BY pos), 1, 5), ',') AS shown, greatest(count(*) - 5, 0) AS more FROM lines GROUP BY doc_id")
def q_top(spark, sf):
    t = lines(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("all"))
    first, more = G.shown(F.col("all"))
    return t.select("doc_id", F.array_join(first, ",").alias("shown"), more.alias("more"))


@query("list_numbering", """SELECT o_orderkey, level, prefix FROM (SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS level, coalesce(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 25 END, o_custkey % 5) AS style FROM orders) i
 LEFT JOIN (SELECT n_nationkey AS style, CAST(n_regionkey % 4 AS INTEGER) AS level, n_name AS prefix FROM nation) l USING (style, level)""")
def q_list_numbering(spark, sf):
    key = F.col("o_custkey")
    items = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("level"), F.when(key % 3 > 0, key % 25).alias("list_style"), (key % 5).alias("parent_style"))
    levels = table(spark, sf, "nation").select(F.col("n_nationkey").alias("list_style"), (F.col("n_regionkey") % 4).cast("int").alias("level"), F.col("n_name").alias("prefix"))
    return L.list_numbering(items, levels).select("o_orderkey", "level", "prefix")


@query("document_signs", LINES + "SELECT doc_id, bool_or(contains(line, '**')) AS emphasis, bool_or(contains(line, '|')) AS tables, bool_or(contains(line, '\"')) AS quotes FROM lines GROUP BY doc_id")
def q_signs(spark, sf):
    return G.any_of(lines(spark, sf), "doc_id", {n: F.col("line").contains(m) for n, m in (("emphasis", "**"), ("tables", "|"), ("quotes", '"'))})


@query("selected_formats", """SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(CASE c_custkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.docx' WHEN 2 THEN '' ELSE '.html' END))), ';') AS formats FROM customer GROUP BY 1""")
def q_formats(spark, sf):
    name = F.concat("c_name", F.element_at(F.array(F.lit(".MD"), F.lit(".docx"), F.lit(""), F.lit(".Html")), (F.col("c_custkey") % 4 + 1).cast("int")))
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list(name).alias("n")).select("c_nationkey", F.array_join(G.formats(F.col("n")), ";").alias("formats"))


@query("missing_styles", """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(['c' || (p_partkey % 5), 'c' || (p_size % 7)], lambda c: c NOT IN ('c1', 'c3', 'c5')))), ';') AS missing FROM part""")
def q_missing(spark, sf):
    html = F.concat(F.lit('<p class="c'), (F.col("p_partkey") % 5).cast("string"), F.lit(" c"), (F.col("p_size") % 7).cast("string"), F.lit('">x</p>'))
    return table(spark, sf, "part").select("p_partkey", F.array_join(G.missing_classes(html, F.lit("p.c1 { color: red } .c3, .c5 > b { margin: 0 }")), ";").alias("missing"))


@query("latest_selection", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_latest(spark, sf):
    return G.latest(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("conversion_outcomes", "SELECT lower('.' || split_part(event_type, '_', 1)) AS suffix, value > 50 AS ok, count(*) AS n FROM events GROUP BY 1, 2")
def q_outcomes(spark, sf):
    named = table(spark, sf, "events").select(F.concat(F.lit("file."), F.upper(F.substring_index("event_type", "_", 1))).alias("name"), (F.col("value") > 50).alias("ok"))
    return G.outcomes(named, "name", "ok")


@query("changelog_sections", LINES + """, l AS (SELECT doc_id, pos, CASE WHEN pos % 6 = 0 THEN '## v' || pos WHEN pos % 6 IN (1, 3) THEN '- x' || pos ELSE 'y' || pos END AS line FROM lines),
s AS (SELECT *, CAST(sum((line LIKE '## %')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section FROM l),
e AS (SELECT *, sum((line LIKE '- %')::INTEGER) OVER (PARTITION BY doc_id, section ORDER BY pos) AS entry FROM s WHERE section > 0),
j AS (SELECT doc_id, section, entry, string_agg(CASE WHEN line NOT LIKE '## %' THEN regexp_replace(line, '^- ', '') END, ' ' ORDER BY pos) AS t, max(CASE WHEN line LIKE '## %' THEN line[4:] END) AS h FROM e GROUP BY 1, 2, 3)
SELECT doc_id, section, max(h) AS title, coalesce(string_agg(t, '|' ORDER BY entry) FILTER (entry > 0), '') AS entries FROM j GROUP BY 1, 2""")
def q_changelog(spark, sf):
    k = F.col("pos") % 6
    p = F.col("pos").cast("string")
    line = F.when(k == 0, F.concat(F.lit("## v"), p)).when(k.isin(1, 3), F.concat(F.lit("- x"), p)).otherwise(F.concat(F.lit("y"), p))
    found = G.changelog(lines(spark, sf).withColumn("line", line), "doc_id", "pos", "line")
    return found.select("doc_id", "section", "title", F.array_join("entries", "|").alias("entries"))

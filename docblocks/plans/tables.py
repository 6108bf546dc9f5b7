"""Queries of the table operators and of the validator."""

from __future__ import annotations

from pyspark.sql import functions as F

from docblocks.operators import tables as B
from docblocks.operators import validate
from docblocks.plans.registry import query, strip_sql, table, words_sql

#: A place of its own for every row.
_POS = "(l_linenumber * 1000000 + l_partkey * 100 + l_suppkey) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)"


def cells(spark, sf):
    """Cells of a table for each order: ``p`` orders them, every row has three."""
    return spark.sql(f"SELECT l_orderkey, l_partkey, {_POS} AS p, CAST(l_suppkey % 3 + 1 AS INT) AS span, l_quantity, l_returnflag FROM {{lineitem}}", lineitem=table(spark, sf, "lineitem"))


@query("grid_columns", f"SELECT l_orderkey, p, span, CAST(coalesce(sum(span) OVER (PARTITION BY l_orderkey ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS gridcol FROM (SELECT l_orderkey, {_POS} AS p, CAST(l_suppkey % 3 + 1 AS INTEGER) AS span FROM lineitem) x")
def q_grid(spark, sf):
    return B.grid_columns(cells(spark, sf), ["l_orderkey"], "p", "span").select("l_orderkey", "p", "span", "gridcol")


@query("table_columns", "SELECT l_orderkey, CAST(max(s) AS BIGINT) AS columns FROM (SELECT l_orderkey, l_returnflag, sum(l_suppkey % 3 + 1) AS s FROM lineitem GROUP BY 1, 2) x GROUP BY 1")
def q_columns(spark, sf):
    return B.column_count(cells(spark, sf), "l_orderkey", "l_returnflag", "span")


@query("rowspans", f"""SELECT l_orderkey, p, CAST(count(*) OVER (PARTITION BY l_orderkey, g) AS INTEGER) AS rowspan FROM (SELECT *, sum((NOT c)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY p) AS g FROM (SELECT l_orderkey, {_POS} AS p, l_returnflag = 'R' AS c FROM lineitem) a) b WHERE g > 0 QUALIFY NOT c""")
def q_rowspans(spark, sf):
    t = cells(spark, sf).withColumn("c", F.col("l_returnflag") == "R")
    return B.merged_rows(t, ["l_orderkey"], "p", "c").select("l_orderkey", "p", "rowspan")


@query("repeated_cells", f"""WITH c AS (SELECT l_orderkey, {_POS} AS p, CAST(l_quantity AS INTEGER) % 12 + 1 AS n, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS v FROM lineitem),
k AS (SELECT *, max(CASE WHEN v <> '' THEN p END) OVER (PARTITION BY l_orderkey) AS last FROM c),
f AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER (PARTITION BY l_orderkey) AS total FROM k WHERE p <= last)
SELECT l_orderkey, CAST(b + i AS INTEGER) AS col, v, total > 32 AS cut FROM (SELECT *, unnest(range(0, CAST(greatest(0, least(n, 32 - b)) AS BIGINT))) AS i FROM f) x""")
def q_repeats(spark, sf):
    t = cells(spark, sf).select("l_orderkey", "p", (F.col("l_quantity").cast("int") % 12 + 1).alias("n"), F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("v"))
    return B.expand_repeats(t, "l_orderkey", "p", "n", "v")


@query("column_widths", f"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) % 4 AS col FROM documents),
cells AS (SELECT doc_id, col, len(t) AS l, list_max(list_transform({words_sql('line')}, lambda w: len(w))) AS w FROM (SELECT doc_id, col, line, {strip_sql('line')} AS t FROM raw) x),
need AS (SELECT doc_id, col, CAST(greatest(max(coalesce(w, 1)), 1) + 2 AS DOUBLE) AS n, CAST(greatest(max(l), 1) + 2 AS DOUBLE) AS w FROM cells GROUP BY 1, 2),
a AS (SELECT *, sum(n) OVER t AS sn, sum(w) OVER t AS sw FROM need WINDOW t AS (PARTITION BY doc_id)),
b AS (SELECT *, CASE WHEN sw <= 110 THEN w WHEN sn >= 110 THEN n ELSE n + (110 - sn) * (w - n) / nullif(sw - sn, 0) END AS b FROM a),
p AS (SELECT *, 100 * b / sum(b) OVER (PARTITION BY doc_id) AS p FROM b),
f AS (SELECT *, count(*) OVER t AS k, count(*) FILTER (p >= 5) OVER t AS wide, sum(CASE WHEN p >= 5 THEN p END) OVER t AS sum_wide FROM p WINDOW t AS (PARTITION BY doc_id)),
r AS (SELECT doc_id, col, round_even(CASE WHEN wide IN (0, k) THEN p WHEN p < 5 THEN 5 ELSE p * (100 - 5 * (k - wide)) / sum_wide END, 1) AS r FROM f)
SELECT doc_id, col, round_even(CASE WHEN col = max(col) OVER t THEN 100 - (sum(r) OVER t - r) ELSE r END, 1) AS width FROM r WINDOW t AS (PARTITION BY doc_id)""")
def q_widths(spark, sf):
    """Every document as a table of four columns: line n is a cell of column n mod 4."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("col", F.col("pos") % 4)
    return B.content_widths(docs, "doc_id", "col", "text")


@query("grid_percentages", """SELECT n_regionkey, n_nationkey, round_even(CASE WHEN n_nationkey = max(n_nationkey) OVER w THEN 100 - (sum(r) OVER w - r) ELSE r END, 1) AS width FROM (SELECT *, round_even(100 * CAST(n_nationkey * 97 + 40 AS DOUBLE) / sum(n_nationkey * 97 + 40) OVER (PARTITION BY n_regionkey), 1) AS r FROM nation) x WINDOW w AS (PARTITION BY n_regionkey)""")
def q_pct(spark, sf):
    t = table(spark, sf, "nation").withColumn("t", (F.col("n_nationkey") * 97 + 40).cast("double"))
    return B.grid_percentages(t, "n_regionkey", "n_nationkey", "t").select("n_regionkey", "n_nationkey", "width")


@query("table_widths", "SELECT p_partkey, CAST(CASE WHEN pct > 0 THEN greatest(10, least(100, round_even(pct, 0))) END AS INTEGER) AS width FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_partkey % 130 WHEN 1 THEN CAST(p_partkey AS DOUBLE) * 3 / 50 WHEN 2 THEN 100 * CAST(p_partkey * 5 AS DOUBLE) / 9000 END AS pct FROM part) x")
def q_table_width(spark, sf):
    k, n = F.col("p_size") % 4, F.col("p_partkey")
    value = F.when(k == 0, F.concat((n % 130).cast("string"), F.lit("%"))).when(k == 1, (n * 3).cast("string")).when(k == 2, (n * 5).cast("string")).otherwise("auto")
    kind = F.when(k == 1, "pct").when(k == 2, "dxa").otherwise("auto")
    return table(spark, sf, "part").select("p_partkey", B.table_width(value, kind, F.lit(9000)).alias("width"))


@query("equal_columns", "SELECT n_regionkey, count(*) > 1 AND max(n_nationkey) - min(n_nationkey) <= 1 AS equal FROM nation GROUP BY 1")
def q_equal(spark, sf):
    t = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.col("n_nationkey").cast("double")).alias("w"))
    return t.select("n_regionkey", B.equal_columns(F.col("w")).alias("equal"))


@query("validated_pages", r"""SELECT page_id, b LIKE '%```%' AS fence, regexp_matches(b, '(?i)<(h[1-6]|div|iframe|script)\b') AS tag, regexp_matches(b, '\[[^\]]+\]\(https?://') AS link, regexp_matches(b, '>\s*[-–—]{3,}\s*<') AS separator,
 len(regexp_extract_all(b, '(?i)<li\b')) > len(regexp_extract_all(b, '(?i)<li[^>]*\sclass=')) AS list_item
FROM (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) ELSE html END AS b FROM pages) x""")
def q_validated(spark, sf):
    found = validate.checks(F.col("html"))
    return table(spark, sf, "pages").select("page_id", *[found[k].alias(k) for k in ("fence", "tag", "link", "separator", "list_item")])


@query("validated_blocks", None)
def q_validated_blocks(spark, sf):
    from docblocks.plans.ordered import q_block_html

    return q_block_html(spark, sf).select("doc_id", F.array_join(validate.warnings(F.col("html")), ",").alias("warnings"))

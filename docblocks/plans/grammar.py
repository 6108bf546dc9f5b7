"""Queries of the inline grammar, entities, image headers, held tokens, path identity and reports."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from docblocks.functions import entities, images, paths
from docblocks.functions import text as T
from docblocks.functions import tokens as K
from docblocks.operators import inline as I
from docblocks.operators import reports as G
from docblocks.plans.registry import LINES, lines, query, table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The names of the standard as a table.
_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in sorted(html5.items())) + ") v(name, char))"


@query("entities", "WITH " + _NAMES + r""", t AS (SELECT page_id, unnest(regexp_extract_all(html || '&copycat&notit;&#8212;&#x1F600&nosuch;&', '(?s)(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&)')) AS tok, generate_subscripts(regexp_extract_all(html || '&copycat&notit;&#8212;&#x1F600&nosuch;&', '(?s)(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&)'), 1) AS i FROM pages),
d AS (SELECT DISTINCT tok, rtrim(substr(tok, 2), ';') AS bare FROM t WHERE tok LIKE '&_%'),
p AS (SELECT d.tok, arg_max(n.char || substr(d.tok, 2 + length(n.name)), length(n.name)) AS txt FROM d JOIN names n ON n.name = substr(d.tok, 2) OR (n.name NOT LIKE '%;' AND starts_with(substr(d.tok, 2), n.name)) GROUP BY d.tok),
c AS (SELECT tok, CASE WHEN bare LIKE '#x%' THEN chr(CAST('0x' || substr(bare, 3) AS INTEGER)) WHEN bare LIKE '#%' THEN chr(CAST(substr(bare, 2) AS INTEGER)) END AS txt FROM d WHERE bare LIKE '#_%')
SELECT page_id, string_agg(coalesce(c.txt, p.txt, t.tok), '' ORDER BY i) AS text FROM t LEFT JOIN p ON p.tok = t.tok LEFT JOIN c ON c.tok = t.tok GROUP BY page_id""")
def q_entities(spark, sf):
    """Whole pages with their references resolved; at the end of each stand some that pages seldom have."""
    html = F.concat("html", F.lit("&copycat&notit;&#8212;&#x1F600&nosuch;&"))
    return table(spark, sf, "pages").select("page_id", entities.unescape(html).alias("text"))


#: A line with its words marked by their places, so that marks stand in one another.
_MARKED = """array_join(transform(split(line, ' '), (w, i) -> CASE i % 9 WHEN 1 THEN concat('**', w) WHEN 2 THEN concat('*', w, '*') WHEN 3 THEN concat('~~', w, '~~**') WHEN 5 THEN concat('[', w, ' *x*](https://h/(', i, '))') WHEN 6 THEN concat('<red>', w) WHEN 7 THEN concat(w, '</red>') WHEN 8 THEN concat('\\\\*', w) ELSE w END), ' ')"""


@query("inline_runs")
def q_runs(spark, sf):
    """Runs of every line, its words marked by their places."""
    found = I.runs(lines(spark, sf).withColumn("line", F.expr(_MARKED)), "line")
    # an outer one, since Spark would put a filter with all of the runs' expression before a plain one
    return found.select("doc_id", "pos", F.posexplode_outer("runs").alias("n", "run")).where("n is not null").select("doc_id", "pos", "n", "run.*")


@query("image_sizes", """SELECT p_partkey, format, CASE WHEN format = 'other' THEN NULL ELSE p_size END AS width, CASE WHEN format = 'other' THEN NULL ELSE CAST(p_partkey % 4000 + 1 AS INTEGER) END AS height FROM (SELECT p_partkey, p_size, ['png', 'gif', 'jpeg', 'other'][p_partkey % 4 + 1] AS format FROM part) x""")
def q_images(spark, sf):
    """Headers of three formats, and of none, whose sizes are those of parts; before a JPEG's frame stand as many segments as the part has letters in its brand."""
    wide = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    turned = lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))
    w, h = F.col("p_size"), F.col("p_partkey") % 4000 + 1
    name = F.hex(F.col("p_name").cast("binary"))
    kept = F.concat(F.lit("FFE1"), wide(F.octet_length("p_name") + 2, 2), name)
    segments = F.repeat(kept, F.length("p_brand"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(w, 4), wide(h, 4), F.lit("08020000"))
    gif = F.concat(F.lit("474946383961"), turned(wide(w, 2)), turned(wide(h, 2)), F.lit("F70000"))
    jpeg = F.concat(F.lit("FFD8"), segments, F.lit("FFFFC40004FFC0FFC2001108"), wide(h, 2), wide(w, 2), F.lit("03012200021101031101"))
    kind = F.get(F.array(*[F.lit(f) for f in ("png", "gif", "jpeg", "other")]), F.col("p_partkey") % 4)
    digits = F.when(kind == "png", png).when(kind == "gif", gif).when(kind == "jpeg", jpeg).otherwise(F.concat(F.lit("424D"), name))
    sizes = table(spark, sf, "part").select("p_partkey", kind.alias("format"), images.size(F.unhex(digits)).alias("size"))
    return sizes.select("p_partkey", "format", "size.width", "size.height")


@query("held_tokens", LINES + r"""SELECT doc_id, pos, len(regexp_extract_all(line || '\*' || chr(57344) || '\', '\\[!-/:-@\[-`{-~]|' || chr(57344))) AS held, line || '\*' || chr(57344) || '\' AS text FROM lines""")
def q_held(spark, sf):
    """Every line with an escaped mark, a placeholder and a lone backslash: how much is held back, and the text as it comes back."""
    held, bare = K.hold(F.concat("line", F.lit("\\*\ue000\\")), K.ESCAPE)
    rows = lines(spark, sf).withColumns({"tokens": held, "bare": bare})
    return rows.select("doc_id", "pos", F.size("tokens").cast("long").alias("held"), K.restore(F.col("bare"), F.col("tokens")).alias("text"))


@query("typed_marks", LINES + r""", n AS (SELECT doc_id, pos, line, CAST(pos % 4 + 1 AS INTEGER) AS columns, ['', 'sup', 'sub'][pos % 3 + 1] AS vertical, pos % 2 = 0 AS underline FROM lines)
SELECT doc_id, pos, columns, line || chr(57360) || chr(57367) || '1' AS text, underline AND true AS underline, vertical, CAST(len(line) % 100 AS DOUBLE) AS width, CAST(pos AS VARCHAR) || '.5' AS widths FROM n""")
def q_marks(spark, sf):
    """Every line, with characters of the marks in it, as a cell over columns, as formatted text and as widths, each written and read again."""
    dirty = F.concat("line", F.lit(f"{K.CELL}{K.SHIELD}1"))
    plain = K.shield(dirty)
    vertical = F.get(F.array(*[F.lit(v) for v in K.VERTICAL]), F.col("pos") % 3)
    cell = K.with_columns(plain, (F.col("pos") % 4 + 1).cast("int"))
    mark = K.with_format(plain, F.col("pos") % 2 == 0, vertical)
    grid = K.with_widths((F.length("line") % 100).cast("double"), F.array(F.col("pos") + 0.5))
    rows = lines(spark, sf).withColumns({"cell": cell, "mark": mark, "grid": grid})
    (columns, text), (width, widths), part = K.columns_of(F.col("cell")), K.widths_of(F.col("grid")), F.get(K.formats_of(F.col("mark")), F.lit(0))
    rows = rows.select("doc_id", "pos", columns.alias("columns"), text.alias("text"), part.alias("part"), width.alias("width"), F.array_join(widths.cast("array<string>"), ",").alias("widths"))
    same = F.when(F.col("part.text") == F.col("text"), K.unshield(F.col("text")))
    return rows.select("doc_id", "pos", "columns", same.alias("text"), F.col("part.underline").alias("underline"), F.col("part.vertical").alias("vertical"), "width", "widths")


_PATHS = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/In/./' || folder || '//x/../' || (page_id % 40) || '.MD' WHEN 1 THEN 'file:///in/' || folder || '/' || (page_id % 40) || '.md' WHEN 2 THEN '\\\\in\\\\' || upper(folder) || '\\\\' || (page_id % 40) || '.md' ELSE '/a/../in/' || folder || '/' || (page_id % 40) || '.html' END AS path
 FROM (SELECT page_id, regexp_extract(url, '^https?://([a-z]+)', 1) AS folder FROM pages) f"""


@query("path_owners", f"""WITH p AS ({_PATHS.replace(chr(92) * 2, chr(92))}), i AS (SELECT page_id, path, lower(regexp_replace(regexp_replace(replace(regexp_replace(path, '^file:/*', '/'), chr(92), '/'), '/\\./|//', '/', 'g'), '/[a-z]+/\\.\\.', '', 'g')) AS k FROM p)
SELECT page_id, path, min(page_id) OVER (PARTITION BY k) AS owner, count(*) OVER (PARTITION BY k) AS names FROM i""")
def q_owners(spark, sf):
    """Outputs written in four ways: the first page that names a file owns it, whatever the case of its letters and the dots in its path."""
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([a-z]+)", 1).alias("folder"))
    end, at, folder = (F.col("page_id") % 40).cast("string"), F.col("page_id") % 4, F.col("folder")
    path = (
        F.when(at == 0, F.concat(F.lit("/In/./"), folder, F.lit("//x/../"), end, F.lit(".MD")))
        .when(at == 1, F.concat(F.lit("file:///in/"), folder, F.lit("/"), end, F.lit(".md")))
        .when(at == 2, F.concat(F.lit("\\in\\"), F.upper(folder), F.lit("\\"), end, F.lit(".md")))
        .otherwise(F.concat(F.lit("/a/../in/"), folder, F.lit("/"), end, F.lit(".html")))
    )
    named = rows.select("page_id", path.alias("path")).withColumn("k", paths.identity(F.col("path")))
    owners = named.groupBy("k").agg(F.min("page_id").alias("owner"), F.count("*").alias("names"))
    return named.join(owners, "k").select("page_id", "path", "owner", "names")


_RESULTS = "SELECT event_id, '.' || split_part(event_type, '_', 1) AS suffix, value > 20 AS ok, CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 4 AS INTEGER) ELSE 0 END AS quotes, CAST(event_id % 2 AS INTEGER) AS headers, CAST(user_id % 3 AS INTEGER) AS warnings FROM events"


def _results(spark, sf):
    kind = F.concat(F.lit("."), F.substring_index("event_type", "_", 1))
    said = F.transform(F.sequence(F.lit(1), (F.col("user_id") % 3).cast("int")), lambda i: F.concat(F.lit("w"), i.cast("string")))
    warnings = F.when(F.col("user_id") % 3 > 0, said).otherwise(F.array().cast("array<string>"))
    quotes = F.when(F.col("event_id") % 3 == 0, (F.col("user_id") % 4).cast("int")).otherwise(0)
    return table(spark, sf, "events").select("event_id", kind.alias("suffix"), (F.col("value") > 20).alias("ok"), quotes.alias("quotes"), (F.col("event_id") % 2).cast("int").alias("headers"), warnings.alias("warnings"))


@query("report_roll_up", f"""WITH r AS ({_RESULTS}) SELECT CASE WHEN grouping(suffix) = 0 THEN 'suffix' WHEN grouping(ok) = 0 THEN 'ok' ELSE 'all' END AS "by", suffix, ok, count(*) AS documents, count(*) FILTER (q.ok2) AS converted, count(*) FILTER (q.ok2 AND quotes > 0) AS with_quotes,
 CAST(coalesce(sum(quotes) FILTER (q.ok2), 0) AS BIGINT) AS quotes, count(*) FILTER (q.ok2 AND headers > 0) AS with_headers, CAST(coalesce(sum(headers) FILTER (q.ok2), 0) AS BIGINT) AS headers, CAST(coalesce(sum(warnings) FILTER (q.ok2), 0) AS BIGINT) AS warnings FROM (SELECT *, ok AS ok2 FROM r) q GROUP BY GROUPING SETS ((), (suffix), (ok))""")
def q_roll_up(spark, sf):
    return G.roll_up(_results(spark, sf))


@query("report_first_lines", f"""WITH r AS ({_RESULTS}), l AS (SELECT suffix, event_id, i, 'e' || event_id || ': w' || i AS line FROM r, LATERAL (SELECT unnest(range(1, warnings + 1)) AS i) x), g AS (SELECT 'all' AS "by", NULL AS suffix, event_id, i, line FROM l UNION ALL SELECT 'suffix', suffix, event_id, i, line FROM l)
SELECT "by", suffix, array_to_string(list_slice(list(line ORDER BY event_id, i), 1, 10), '|') AS lines, greatest(count(*) - 10, 0) AS more FROM g GROUP BY 1, 2""")
def q_first_lines(spark, sf):
    named = _results(spark, sf).withColumn("name", F.concat(F.lit("e"), F.col("event_id").cast("string")))
    return G.first_lines(named, "name", "event_id", "warnings").withColumn("lines", F.array_join("lines", "|"))


@query("nameless_reports", r"""WITH n AS (SELECT l_orderkey, list(DISTINCT 'doc' || l_partkey || '.odt') AS names, list('erro em doc' || l_partkey || '.odt e doc' || l_partkey || ', veja Nota-' || l_suppkey || '.PDF' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey, lines, list_sort(list_transform(list_distinct(list_concat(names, list_transform(names, lambda x: replace(x, '.odt', '')))), lambda x: (-length(x), x))) AS names FROM n),
c AS (SELECT l_orderkey, len(lines) AS n, list_transform(list_slice(lines, 1, 10), lambda l: '- ' || regexp_replace(list_reduce(list_transform(names, lambda s: s[2]), lambda t, x: replace(t, x, '<arquivo>'), l), '(?i)[^\s\[\]:|"''()]+\.(docx?|odt|pdf|md|txt|rtf|html?)\b', '<arquivo>', 'g')) AS shown FROM b)
SELECT l_orderkey, array_to_string(shown, '|') || CASE WHEN n > 10 THEN '|- e mais ' || (n - 10) || '.' ELSE '' END AS report FROM c""")
def q_nameless(spark, sf):
    """A report for every order, about files that its lines name with and without their suffix, some names being the beginning of others."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    # texts are made of an order's numbers after these have met
    name = lambda x: F.concat(F.lit("doc"), x["l_partkey"].cast("string"))
    line = lambda x: F.concat(F.lit("erro em "), name(x), F.lit(".odt e "), name(x), F.lit(", veja Nota-"), x["l_suppkey"].cast("string"), F.lit(".PDF"))
    names = F.array_distinct(F.transform("x", lambda x: F.concat(name(x), F.lit(".odt"))))
    return rows.select("l_orderkey", F.array_join(G.report_lines(F.transform("x", line), names), "|").alias("report"))


@query("link_targets", r"""SELECT page_id, CASE WHEN bare <> '' AND NOT starts_with(bare, '#') AND (s = '' OR s IN ('http','https','mailto','tel','ftp')) THEN replace(replace(replace(bare, ' ', '%20'), '(', '%28'), ')', '%29') END AS target
FROM (SELECT page_id, bare, lower(regexp_extract(regexp_replace(bare, '[\x00-\x20]', '', 'g'), '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s FROM (SELECT page_id, trim(CASE page_id % 6 WHEN 0 THEN 'JAVA script:' || url WHEN 1 THEN '  ' WHEN 2 THEN ' ' || url || ' (x y)' WHEN 3 THEN 'mailto:' || url WHEN 4 THEN 'data:' || url ELSE '#' || url END) AS bare FROM pages) b) c""")
def q_targets(spark, sf):
    k, url = F.col("page_id") % 6, F.col("url")
    href = F.when(k == 0, F.concat(F.lit("JAVA script:"), url)).when(k == 1, "  ").when(k == 2, F.concat(F.lit(" "), url, F.lit(" (x y)"))).when(k == 3, F.concat(F.lit("mailto:"), url)).when(k == 4, F.concat(F.lit("data:"), url)).otherwise(F.concat(F.lit("#"), url))
    return table(spark, sf, "pages").select("page_id", T.link_target(href).alias("target"))


_STRUCK = "CASE pos % 5 WHEN 0 THEN concat('~~', line, '~~') WHEN 1 THEN concat('~~', line, '~~ ~~', pos, '~~') WHEN 2 THEN concat('~~**', pos + 1, '\\\\. ', line, '**~~') WHEN 3 THEN concat('*~~', pos, '.1~~* ', line) ELSE line END"


@query("struck_paragraphs", LINES + r""", s AS (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN '~~' || line || '~~' WHEN 1 THEN '~~' || line || '~~ ~~' || pos || '~~' WHEN 2 THEN '~~**' || (pos + 1) || '\. ' || line || '**~~' WHEN 3 THEN '*~~' || pos || '.1~~* ' || line ELSE line END AS line FROM lines),
f AS (SELECT *, contains(line, '~~') AND trim(regexp_replace(line, '~~(.+?)~~', '', 'g')) = '' AS whole, regexp_matches(ltrim(regexp_replace(line, '\\([!-/:-@\[-`{-~])', '\1', 'g'), '*~ '), '^\s*(\d+\.|\d+(\.\d+)+\.?)\s+\S') AS item FROM s)
SELECT doc_id, pos, whole, item, whole AND NOT item AS struck, '~~' || replace(line, '~~', '') || '~~' AS again FROM f""")
def q_struck(spark, sf):
    """Lines struck as a whole, in parts and as items: which of them are struck paragraphs."""
    line = F.col("line")
    rows = lines(spark, sf).withColumn("line", F.expr(_STRUCK))
    return rows.select("doc_id", "pos", T.is_whole_struck(line).alias("whole"), T.starts_with_item(line).alias("item"), T.is_struck(line).alias("struck"), T.strike_whole(line).alias("again"))

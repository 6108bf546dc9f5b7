"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations


from . import resampling, setsketch, spaced, suffixes, variants, warc

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Near-duplicate components: all pairs that share a shingle, then a recursive walk from every linked document.
SETSKETCH = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < {setsketch.SHINGLE} THEN [array_to_string(t, ' ')]
 ELSE list_distinct(list_transform(range(1, len(t) - {setsketch.SHINGLE - 2}), lambda i: array_to_string(list_slice(t, i, i + {setsketch.SHINGLE - 1}), ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {setsketch.SIMILARITY[1]} * c >= {setsketch.SIMILARITY[0]} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT x, x FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach),
c AS (SELECT doc_id, min(reach) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id, coalesce(c.least, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

#: Repeated bytes: every window counted by its hash, on hexadecimal text.
SUFFIXES = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, c, substr(x, CAST({2 * suffixes.SPAN} * c + 1 AS BIGINT), {4 * suffixes.SPAN - 2}) AS part FROM (SELECT doc_id, x, unnest(range(0, CAST(ceil(greatest(0, len(x) // 2 - {suffixes.SPAN - 1}) / {suffixes.SPAN}) AS BIGINT))) AS c FROM h) p),
v AS MATERIALIZED (SELECT doc_id, {suffixes.SPAN} * c + j AS i, md5_number(substr(part, CAST(2 * j + 1 AS BIGINT), {2 * suffixes.SPAN})) AS k FROM (SELECT doc_id, c, part, unnest(range(0, least({suffixes.SPAN}, CAST(len(part) // 2 - {suffixes.SPAN - 1} AS BIGINT)))) AS j FROM c) p),
t AS (SELECT k FROM v GROUP BY k HAVING count(*) > 1),
f AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffixes.SPAN} OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS o FROM v WHERE k IN (SELECT k FROM t)),
u AS (SELECT doc_id, i, sum(o) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + {suffixes.SPAN} AS b FROM u GROUP BY 1, 2),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
m AS (SELECT q.doc_id, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(x, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS pre FROM q JOIN h ON h.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT h.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE pre || substr(x, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM h LEFT JOIN m ON m.doc_id = h.doc_id
"""


#: Leaks without any mask: every word that an item and a text share gives a diagonal; along each, words are compared and summed over windows.
SPACED = rf"""WITH d AS MATERIALIZED (SELECT doc_id AS k, unnest(t) AS w, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS p FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS t FROM documents) x),
b AS MATERIALIZED (SELECT item_id AS k, unnest(t) AS w, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS p, least(len(t), {spaced.WINDOW}) AS span FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS t FROM benchmark) x),
h AS MATERIALIZED (SELECT d.k AS doc_id, b.k AS item_id, d.p - b.p AS start FROM d JOIN b ON b.w = d.w WHERE d.w <> '' GROUP BY 1, 2, 3 HAVING count(*) >= ceil(any_value(b.span) * {spaced.SHARE})),
a AS (SELECT h.doc_id, h.item_id, h.start, b.p, b.span, CASE WHEN d.w = b.w THEN 1 ELSE 0 END AS same
 FROM h JOIN b ON b.k = h.item_id LEFT JOIN d ON d.k = h.doc_id AND d.p = h.start + b.p),
o AS (SELECT *, CAST(sum(same) OVER (PARTITION BY doc_id, item_id, start ORDER BY p ROWS BETWEEN {spaced.WINDOW - 1} PRECEDING AND CURRENT ROW) AS INTEGER) AS matched FROM a),
z AS (SELECT doc_id, item_id, start, max(matched) AS matched, any_value(span) AS span FROM o WHERE p >= span - 1 GROUP BY 1, 2, 3)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, matched, CAST(span AS INTEGER) AS compared FROM z WHERE matched >= ceil(span * {spaced.SHARE})
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1
"""
#: The table of the 32-bit checksum, by its rule, and the checksum of a list of bytes.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(range(0, 8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS codes FROM range(0, 256) r(i))"
_CRC = "xor(list_reduce(list_transform(range(0, len(hex(encode({x}))) // 2), lambda i: (strpos('0123456789ABCDEF', substr(hex(encode({x})), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({x})), 2 * i + 2, 1)) - 1), lambda c, b: xor(c >> 8, codes[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295)"

#: Spelling variants: pairs by what is left of words without one of their characters; forms followed by recursion.
VARIANTS = f"""WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
g AS (SELECT d, w, count(*) AS c FROM r WHERE length(w) >= {variants.LEAST_CHARS} GROUP BY 1, 2),
h AS (SELECT w, c, {_CRC.format(x="d || ':' || w")} AS h FROM g, crc),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word, c FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM e WHERE length(word) >= {variants.LEAST_CHARS} GROUP BY word HAVING sum(c) >= 5),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) u),
p AS (SELECT a.word, a.n, b.word AS o, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT a.word, a.n, b.word, b.n FROM x a JOIN words b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM x a JOIN words b ON a.rest = b.word),
b AS (SELECT word, count(*) AS n_near, arg_min(o, (-m, o)) AS o, max(m) AS m, any_value(n) AS n FROM p GROUP BY word),
f AS (SELECT word, n_near, CASE WHEN m >= {variants.RATIO} * n THEN o END AS form, CASE WHEN m >= {variants.RATIO} * n THEN m END AS form_n FROM b),
z(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL),
y AS (SELECT z.word, z.root FROM z LEFT JOIN f ON f.word = z.root WHERE f.form IS NULL)
SELECT w.word, f.form, coalesce(y.root, w.word) AS root, w.n, CAST(coalesce(f.n_near, 0) AS BIGINT) AS n_near, f.form_n FROM words w LEFT JOIN f ON f.word = w.word LEFT JOIN y ON y.word = w.word
"""

#: Importance resampling: buckets of distinct words, gains joined back, one order over all scores.
_BUCKET = f"CAST({_CRC.format(x='w')} % {resampling.BUCKETS} AS INTEGER)"
_WORDS = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
RESAMPLING = f"""WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
f AS MATERIALIZED (SELECT k, {_WORDS} AS w FROM d), bf AS (SELECT {_WORDS} AS w FROM benchmark),
v AS MATERIALIZED (SELECT w, s, t, {_BUCKET} AS b FROM (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, count(*) AS s, 0 AS t FROM f GROUP BY w UNION ALL SELECT w, 0, count(*) FROM bf GROUP BY w) q GROUP BY w) q, crc),
n AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM v),
g AS (SELECT b, CAST(floor(1000 * ln((any_value(CAST(q.t AS DOUBLE)) + 1) * (any_value(n.s) + {resampling.BUCKETS}) / ((any_value(CAST(q.s AS DOUBLE)) + 1) * (any_value(n.t) + {resampling.BUCKETS})))) AS BIGINT) AS gain
 FROM (SELECT b, sum(s) AS s, sum(t) AS t FROM v GROUP BY b) q, n GROUP BY b),
u AS (SELECT k, count(*) AS c, sum(gain) AS weight FROM f JOIN v ON v.w = f.w JOIN g ON g.b = v.b GROUP BY k),
o AS (SELECT d.k, d.doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
 CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN u ON u.k = d.k),
a AS (SELECT k, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o),
y AS (SELECT *, n_features >= {resampling.LEAST_WORDS} AS able, row_number() OVER (PARTITION BY n_features >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, k) AS place FROM a)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT 10 * count(*) // 100 FROM a WHERE n_features >= {resampling.LEAST_WORDS}) THEN place END AS rank FROM y
"""

#: Pages as their archive must give them back.
WARC = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, n >= {warc.LEAST_REVISIT} AND page_id <> min(page_id) OVER (PARTITION BY payload_digest) AS again, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to FROM f
"""
ORACLES = {"op11_spelling_variants": VARIANTS, "op12_importance_resampling": RESAMPLING, "op13_warc_transactions": WARC, "op2_setsketch": SETSKETCH, "op3_suffix_levels": SUFFIXES, "op7_spaced_seeds": SPACED}

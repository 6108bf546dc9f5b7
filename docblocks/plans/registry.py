"""Registry of named queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with ``seen``, its rows' places: files by name, rows as they lie in them. What DuckDB reads first on one thread has the least."""
    row, file = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    t = table(spark, sf_dir, name)
    if len(t.inputFiles()) < 2:
        return t.select("*", row.alias("seen"))
    files = t.select(file.alias("file_")).distinct().withColumn("nth_", F.row_number().over(Window.orderBy("file_")))
    t = t.select("*", file.alias("file_"), row.alias("seen")).join(F.broadcast(files), "file_")
    return t.withColumn("seen", F.col("nth_") * F.lit(1 << 40) + F.col("seen")).drop("file_", "nth_")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line): lines of documents that have a word."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))


#: The same in DuckDB, to stand before a SELECT.
LINES = r"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents),
lines AS (SELECT * FROM raw WHERE regexp_matches(line, '\S'))
"""


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line): lines of documents, blank ones too."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


ALL_LINES = LINES.replace("SELECT * FROM raw WHERE regexp_matches(line, '\\S')", "SELECT * FROM raw")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a typed number: (doc_id, pos, level, line); levels go 1, 2, 3, 4 with the position, every seventh line has none."""
    level = F.col("pos") % 4 + 1
    number = F.when(level == 1, "1.").when(level == 2, "1.1.").when(level == 3, "1.1.1.").otherwise("1.1.1.1.")
    plain = F.col("pos") % 7 == 6
    return lines(spark, sf_dir).select("doc_id", "pos", F.when(plain, 0).otherwise(level).alias("level"), F.when(plain, F.col("line")).otherwise(F.concat(number, F.lit(" "), "line")).alias("line"))


NUMBERED = LINES + r""", numbered AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 6 THEN 0 ELSE pos % 4 + 1 END AS level,
 CASE WHEN pos % 7 = 6 THEN line ELSE (CASE pos % 4 WHEN 0 THEN '1.' WHEN 1 THEN '1.1.' WHEN 2 THEN '1.1.1.' ELSE '1.1.1.1.' END) || ' ' || line END AS line FROM lines)
"""
#: White space gone from both ends, words and letters, as DuckDB macros written out.
STRIP = r"regexp_replace(regexp_replace({x}, '^[\s\x{{00A0}}]+', ''), '[\s\x{{00A0}}]+$', '')"
WORDS = r"(CASE WHEN " + STRIP + r" = '' THEN [] ELSE regexp_split_to_array(" + STRIP + r", '[\s\x{{00A0}}]+') END)"


def strip_sql(x: str) -> str:
    return STRIP.format(x=x)


def words_sql(x: str) -> str:
    return WORDS.format(x=x)


#: Code blocks of a table ``{source}`` (doc_id, pos, line): each opening fence with the first line that closes it, then those that no earlier
#: block holds, one after the other; ``coded`` is the table with ``code``.
FENCES = r"""fence AS (SELECT doc_id, pos, len(regexp_extract(line, '^(`{{3,}})[^`]*$', 1)) AS ticks, regexp_matches(line, '^`{{3,}}\s*$') AS bare FROM {source} WHERE regexp_matches(line, '^`{{3,}}[^`]*$')),
pairs AS (SELECT o.doc_id, o.pos AS a, min(c.pos) AS b FROM fence o JOIN fence c ON c.doc_id = o.doc_id AND c.pos > o.pos AND c.bare AND c.ticks >= o.ticks GROUP BY 1, 2),
spans AS (WITH RECURSIVE s(doc_id, a, b) AS (SELECT doc_id, min(a), arg_min(b, a) FROM pairs GROUP BY doc_id UNION ALL
 SELECT doc_id, a, b FROM (SELECT s.doc_id, min(p.a) AS a, arg_min(p.b, p.a) AS b FROM s JOIN pairs p ON p.doc_id = s.doc_id AND p.a > s.b GROUP BY s.doc_id) n) SELECT * FROM s),
coded AS (SELECT doc_id, pos, line, EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = t.doc_id AND t.pos BETWEEN s.a AND s.b) AS code FROM {source} t)"""

"""Queries of the watch operators, over events as scans of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from docblocks.plans.registry import query, table
from docblocks.streaming import watch


def scans(spark, sf):
    """Twelve scans of a path for each user; a mark only ever moves on, so that windows can say the same."""
    users = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = users.select("user_id", "n", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("scan_no"))
    there = (F.col("scan_no") + F.col("user_id")) % 11 != 10
    return rows.where(there).select(F.col("user_id"), "scan_no", F.floor((F.col("scan_no") * 3 + F.col("n") % 5) / 7).cast("string").alias("mark"))


_SCANS = """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT user_id, i AS scan_no, CASE WHEN (i + user_id) % 11 <> 10 THEN floor((i * 3 + n % 5) / 7) END AS mark FROM u, range(0, 12) r(i)),
g AS (SELECT *, count(*) FILTER (mark IS NULL) OVER (PARTITION BY user_id ORDER BY scan_no) AS stay FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, stay, mark ORDER BY scan_no) AS nth FROM g WHERE mark IS NOT NULL)
SELECT user_id, CAST(scan_no AS INTEGER) AS scan_no FROM k WHERE nth = 2"""


@query("ready_files", _SCANS)
def q_ready(spark, sf):
    return watch.ready_files(scans(spark, sf), "user_id", "scan_no", "mark")


@query("target_folders", "SELECT page_id, '/out/' || regexp_replace(replace(url, 'https://', ''), '[^/]+$', '') AS folder FROM pages")
def q_folders(spark, sf):
    path = F.concat(F.lit("/in/"), F.replace("url", F.lit("https://"), F.lit("")))
    return table(spark, sf, "pages").select("page_id", watch.target_folder(path, "/in", "/out").alias("folder"))

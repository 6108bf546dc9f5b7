"""Watched folders: a file is ready when two scans in a row show the same mark.

State of a path: the mark pending from the last scan, and the mark it was converted at. A mark that
equals the converted one changes nothing, not even the pending mark. A path that a scan doesn't show
loses its state. In batch this is a fold over each path's scans, as a stream keyed state (``keyed``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docblocks import schemas as S
from docblocks.functions import paths
from docblocks.functions import text as T
from docblocks.sources import snapshots as source
from docblocks.streaming import keyed


def ready_scans(marks: Column) -> Column:
    """Scans (from 0) at which a path is ready, by its marks in the order of scans; null where it wasn't there."""
    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("pending"), F.lit(None).cast("string").alias("done"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, mark: Column) -> Column:
        same = F.coalesce(mark == acc["done"], F.lit(False))
        ready = F.coalesce(mark == acc["pending"], F.lit(False)) & ~same
        gone = mark.isNull()
        none = F.lit(None).cast("string")
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(gone | ready, none).when(same, acc["pending"]).otherwise(mark).alias("pending"),
            F.when(gone, none).when(ready, mark).otherwise(acc["done"]).alias("done"),
            F.when(ready, F.concat(acc["out"], F.array(acc["i"]))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(marks, start, step, lambda acc: acc["out"])


def ready_files(scans: DataFrame, path: str, scan: str, mark: str) -> DataFrame:
    """(path, scan): when each path is ready, from a table of scans (batch form)."""
    bounds = scans.agg(F.min(scan).alias("lo"), F.max(scan).alias("hi"))
    seen = scans.groupBy(path).agg(F.map_from_entries(F.collect_list(F.struct(scan, mark))).alias("m")).crossJoin(F.broadcast(bounds))
    order = F.sequence(F.col("lo"), F.col("hi"))
    marks = F.transform(order, lambda s: F.col("m")[s])
    return seen.select(path, "lo", F.explode(ready_scans(marks)).alias("i")).select(path, (F.col("lo") + F.col("i")).alias(scan))


def watched(scans: DataFrame, every_scan: bool = True, absent_after: timedelta | None = None) -> DataFrame:
    """(path, scan_no, mark, event): "ready" and "gone" from a stream of (scan_no long, path string, mark string).

    A null mark says that the path has gone; its state ends there. ``every_scan``: each scan shows every file, so a gap
    is an absence; false for the source "snapshots", which tells changes. ``absent_after``: how long a path may go
    unmentioned before it counts as gone.
    """
    keyed.use_state_store(scans.sparkSession)
    mode = "none" if absent_after is None else "processingTime"
    processor = keyed.Marks(every_scan, keyed.milliseconds(absent_after))
    return scans.select("path", "scan_no", "mark").groupBy("path").transformWithState(processor, keyed.EVENTS, "append", mode)


def ready_stream(scans: DataFrame, every_scan: bool = True) -> DataFrame:
    """(path, scan_no): when each path of a stream of scans is ready."""
    return watched(scans, every_scan).where(F.col("event") == keyed.READY).select("path", "scan_no")


def claims(events: DataFrame, target: Column) -> DataFrame:
    """Ready rows of ``watched`` with their target and the path that owns it, the identity of targets being that of paths."""
    rows = events.withColumn("target", target).withColumn("claimed", paths.key(F.col("target")))
    return rows.groupBy("claimed").transformWithState(keyed.Owners(), keyed.CLAIMS, "append", "none")


def latest_results(selections: DataFrame, results: DataFrame, ttl: timedelta | None = None) -> DataFrame:
    """(session, version, value): streamed results of each session's latest selection; stale ones are dropped.

    ``selections``: (session string, version long); ``results``: (session, version, value string).
    """
    keyed.use_state_store(results.sparkSession)
    chosen = selections.select("session", "version", F.lit(None).cast("string").alias("value"), F.lit(False).alias("is_result"))
    rows = chosen.union(results.select("session", "version", "value", F.lit(True)))
    return rows.groupBy("session").transformWithState(keyed.Latest(keyed.milliseconds(ttl)), keyed.RESULTS, "append", "none" if ttl is None else "processingTime")


def target_folder(path: Column, root: str, out_root: str) -> Column:
    """The subfolder of ``path`` under ``root``, mirrored under ``out_root``."""
    inside = F.regexp_replace(F.regexp_replace(path, "[^/]+$", ""), f"^\\Q{root.rstrip('/')}\\E/?", "")
    return F.concat(F.lit(out_root.rstrip("/") + "/"), inside)


def snapshots(spark: SparkSession, folder: str, log: str, recursive: bool = False, scans: int | None = None) -> DataFrame:
    """The stream of changes of a folder's candidates; outputs of the engine and unknown suffixes are no candidates."""
    source.register(spark)
    read = spark.readStream.format("snapshots").option("path", folder).option("log", log).option("recursive", str(recursive).lower())
    read = read.option("suffixes", ",".join(S.SUPPORTED + S.RETIRED))
    if scans is not None:
        read = read.option("scans", str(scans))
    return read.load().where(T.in_scan(F.col("name")))


def start(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, out: str | None = None, recursive: bool = False, body_only: bool = False, scans: int | None = None, seconds: float = S.WATCH_SECONDS) -> StreamingQuery:
    """Watch a folder: ``sink`` gets the ready files of every scan, (path, name, suffix, target, owner).

    A file whose target belongs to another path has that path as its owner; a path that goes frees its target. The state
    lives in the checkpoint, so a query that starts again goes on where it stopped. ``scans`` ends it after so many.
    """
    events = watched(snapshots(spark, folder, f"{checkpoint.rstrip('/')}/scans", recursive, scans), every_scan=False)
    name = F.element_at(F.split("path", "/"), -1)
    place = target_folder(F.col("path"), folder, out) if out else F.regexp_replace("path", "[^/]+$", "")
    ready = claims(events, F.concat(place, T.output_name(name, body_only)))
    ready = ready.select("path", name.alias("name"), T.suffix(name).alias("suffix"), "target", "owner")
    return ready.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

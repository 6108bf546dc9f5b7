"""Keyed state of the watch streams: a path's marks, the owner of a target, a session's latest selection.

Each is a processor of ``transformWithState`` (Spark's RocksDB state store). State ends when what it is about ends: a
path that is gone has none, a target whose owner is gone is free, and what nobody mentions for ``ttl`` expires.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

READY, GONE = "ready", "gone"
EVENTS = "path string, scan_no long, mark string, event string"


def use_state_store(spark: SparkSession) -> None:
    """These processors need the RocksDB store; queries that have begun keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Marks(StatefulProcessor):
    """Two scans in a row that show one mark make a path ready; a null mark says that it has gone.

    State: the last scan, the mark pending from it and the mark converted. With ``every_scan``, each scan shows every
    file that is there, so a gap between scans means that the file was away. ``absent_after`` (milliseconds) sets
    a timer at every sighting: a path that no scan mentions for so long is gone.
    """

    def __init__(self, every_scan: bool, absent_after: int | None):
        self.every_scan, self.absent_after = every_scan, absent_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("marks", "last long, pending string, done string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, pending, done = self.state.get() if self.state.exists() else (None, None, None)
        known = last is not None
        for scan, mark in sorted(((r["scan_no"], r["mark"]) for r in rows), key=lambda x: x[0]):
            if mark is None or (self.every_scan and last is not None and scan > last + 1):
                pending = done = None
            last = scan
            if mark is None:
                if known:
                    yield Row(path=key[0], scan_no=scan, mark=None, event=GONE)
                known = False
                continue
            known = True
            if mark == done:  # not even the pending mark changes
                continue
            if mark == pending:
                pending, done = None, mark
                yield Row(path=key[0], scan_no=scan, mark=mark, event=READY)
            else:
                pending = mark
        if not known:
            self.state.clear()
        else:
            self.state.update((last, pending, done))
        if self.absent_after is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if known:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.absent_after)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            last = self.state.get()[0]
            self.state.clear()
            yield Row(path=key[0], scan_no=last, mark=None, event=GONE)

    def close(self) -> None:
        pass


#: What a ready file may do with its target: write it, or give way to its owner.
CLAIMS = "path string, scan_no long, mark string, event string, target string, owner string"


class Owners(StatefulProcessor):
    """The first path that is ready for a target owns it until it is gone; others are told who does.

    Rows of one scan come in order of their paths; those that are gone come first, so a name that one scan frees can be taken in it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "path string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        owner = self.owner.get()[0] if self.owner.exists() else None
        for r in sorted(rows, key=lambda r: (r["scan_no"], r["event"] != GONE, r["path"])):
            if r["event"] == GONE:
                if owner == r["path"]:
                    owner = None
                continue
            owner = owner or r["path"]
            yield Row(path=r["path"], scan_no=r["scan_no"], mark=r["mark"], event=r["event"], target=r["target"], owner=owner)
        if owner is None:
            self.owner.clear()
        else:
            self.owner.update((owner,))

    def close(self) -> None:
        pass


RESULTS = "session string, version long, value string"


class Latest(StatefulProcessor):
    """Results of a session's latest selection; what belongs to an earlier one comes too late and is dropped.

    A selection (no value) supersedes those of lower versions at once, results in the same batch included. A result whose
    selection has not been seen yet announces it. A session that is idle for ``ttl`` (milliseconds) is forgotten.
    """

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        latest = self.version.get()[0] if self.version.exists() else None
        kept: list[Row] = []  # results of the latest version so far
        for r in rows:
            if latest is None or r["version"] > latest:
                latest, kept = r["version"], []
            if r["is_result"] and r["version"] == latest:
                kept.append(r)
        if latest is not None:
            self.version.update((latest,))
        for r in kept:
            yield Row(session=key[0], version=r["version"], value=r["value"])

    def close(self) -> None:
        pass


def milliseconds(span: timedelta | None) -> int | None:
    return None if span is None else int(span.total_seconds() * 1000)

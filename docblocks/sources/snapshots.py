"""A watched folder as a data source ("snapshots"): its files in batch, and what scans find changed as a stream.

Rows are (scan_no, path, name, suffix, mark); a mark is the file's time of change and its size, and null for
a file that a scan doesn't show any more. The folder itself and each of its subfolders are partitions, which
tasks walk; filters on ``suffix`` are pushed into the walk, so other files are not even asked for their marks.

An offset of the stream is the number of a scan. A task writes what it saw into the log folder before it gives any
row, under the name of its scan and its part, and never twice: a task that runs again, or a query that restarts
in the middle of a batch, reads the scan back instead of looking anew. What it gives are differences to the scan
before, so a settled folder gives no rows: a file that is new or changed, the same file once more when the next
scan finds it unchanged (two scans that agree are what makes it ready), and one that has gone. Scans before the
last one committed are removed.

The watched folder and the log must be paths that the driver and all executors share. A file that vanishes
between the listing and the look at its mark is not there; a folder that doesn't exist has no files.

Options: ``path``, ``recursive`` (false), ``suffixes`` (comma-separated; all), and for streams ``log``
(a folder) and ``scans`` (stop after so many; never).
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "scan_no long, path string, name string, suffix string, mark string"
#: Sightings of one mark that are told: the first, and the one that confirms it.
TOLD = 2


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


class Part(InputPartition):
    """One part of a folder: its own files, or a subfolder with all that is below."""

    def __init__(self, folder: str, deep: bool, before: int = 0, scan: int = 0):
        self.folder, self.deep, self.before, self.scan = folder, deep, before, scan


class _Folder:
    """What both readers share: the options, the parts of the folder and the walk of one part."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("snapshots: the option path names the folder")
        self.root = _local(options["path"]).rstrip("/") or "/"
        self.recursive = options.get("recursive", "false").lower() == "true"
        named = [s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip()]
        self.suffixes = set(named) or None

    def parts(self) -> list[tuple[str, bool]]:
        try:
            inside = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)) if self.recursive else []
        except OSError:
            inside = []
        return [(self.root, False), *((d, True) for d in inside)]

    def walk(self, folder: str, deep: bool) -> Iterator[tuple[str, str, str, str]]:
        """(path, name, suffix, mark) of the files of a part."""
        open_folders = [folder]
        while open_folders:
            try:
                entries = sorted(os.scandir(open_folders.pop()), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if deep:
                            open_folders.append(e.path)
                        continue
                    suffix = os.path.splitext(e.name)[1].lower()
                    if (self.suffixes is not None and suffix not in self.suffixes) or not e.is_file():
                        continue
                    seen = e.stat()
                except OSError:
                    continue
                yield e.path, e.name, suffix, f"{seen.st_mtime_ns}:{seen.st_size}"


class Scan(_Folder, DataSourceReader):
    """The files as they are, scan 1."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("suffix",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("suffix",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.suffixes = wanted if self.suffixes is None else self.suffixes & wanted

    def partitions(self) -> list[Part]:
        return [Part(folder, deep) for folder, deep in self.parts()]

    def read(self, part: Part) -> Iterator[tuple]:
        for row in self.walk(part.folder, part.deep):
            yield (1, *row)


class Scans(_Folder, DataSourceStreamReader):
    """What each scan finds changed."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if "log" not in options:
            raise ValueError("snapshots: the option log names a shared folder that keeps the scans of a stream")
        self.log = _local(options["log"])
        self.limit = int(options["scans"]) if "scans" in options else None
        self.last: int | None = None

    def _logged(self) -> list[int]:
        try:
            return sorted(int(n.split("-")[1]) for n in os.listdir(self.log) if n.startswith("scan-"))
        except OSError:
            return []

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        last = self.last if self.last is not None else max(self._logged(), default=0)
        self.last = last + 1 if self.limit is None or last < self.limit else last
        return {"scan": self.last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, scan = start["scan"], end["scan"]
        self.last = max(self.last or 0, scan)
        # parts of the scan before may have gone since, and their files with them
        parts = dict(self.parts())
        for where in (before, scan):
            for entry in self._entries(where):
                with open(entry, encoding="utf-8") as lines:
                    folder, deep = json.loads(next(lines))
                    parts.setdefault(folder, deep)
        return [Part(folder, deep, before, scan) for folder, deep in sorted(parts.items())]

    def _entries(self, scan: int) -> list[str]:
        try:
            return [e.path for e in os.scandir(f"{self.log}/scan-{scan}") if e.name.endswith(".jsonl")]
        except OSError:
            return []

    def _entry(self, scan: int, part: Part) -> str:
        return f"{self.log}/scan-{scan}/{hashlib.sha256(part.folder.encode()).hexdigest()[:32]}.jsonl"

    def _load(self, entry: str) -> dict[str, tuple[str, int]] | None:
        try:
            with open(entry, encoding="utf-8") as lines:
                next(lines)
                return {path: (mark, times) for path, mark, times in map(json.loads, lines)}
        except FileNotFoundError:
            return None

    def _look(self, part: Part, before: dict[str, tuple[str, int]]) -> dict[str, tuple[str, int]]:
        """Scan a part and log it, or what another run of this task has logged before."""
        seen = {}
        for path, _, _, mark in self.walk(part.folder, part.deep):
            old, times = before.get(path, (None, 0))
            seen[path] = (mark, min(times + 1, TOLD + 1) if old == mark else 1)
        entry = self._entry(part.scan, part)
        os.makedirs(os.path.dirname(entry), exist_ok=True)
        handle, name = tempfile.mkstemp(dir=os.path.dirname(entry), prefix=".")
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(json.dumps([part.folder, part.deep]) + "\n")
            out.writelines(json.dumps([path, *said]) + "\n" for path, said in seen.items())
        try:
            os.link(name, entry)  # only the first one counts
        except FileExistsError:
            return self._load(entry) or {}
        finally:
            os.unlink(name)
        return seen

    def read(self, part: Part) -> Iterator[tuple]:
        before = self._load(self._entry(part.before, part)) or {}
        now = self._load(self._entry(part.scan, part))
        if now is None:
            now = self._look(part, before)

        def row(path: str, mark: str | None) -> tuple:
            name = os.path.basename(path)
            return (part.scan, path, name, os.path.splitext(name)[1].lower(), mark)

        for path, (mark, times) in now.items():
            if times <= TOLD:
                yield row(path, mark)
        for path in before.keys() - now.keys():
            yield row(path, None)

    def commit(self, end: dict) -> None:
        for scan in self._logged():
            if scan < end["scan"]:
                for entry in self._entries(scan):
                    os.unlink(entry)
                try:
                    os.rmdir(f"{self.log}/scan-{scan}")
                except OSError:  # a task that is still at work
                    pass


class Snapshots(DataSource):
    """The source that ``spark.read`` and ``spark.readStream`` know as "snapshots"."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Scan:
        return Scan(dict(self.options))

    def streamReader(self, schema: StructType) -> Scans:
        return Scans(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Snapshots)

"""Document files as a sink ("document_files"): rows (target, content) to text files, all of them or none.

A task writes into a staging folder below the sink's ``path`` and tells the driver where its list of files is, and
nothing else. When all tasks have told, the commit moves the files of those lists to their targets and the staging
folder goes; when one fails for good, the abort removes the staging folder and no target was touched. A second
attempt of a task writes a list of its own, and only the list that Spark accepted is moved: what the other left goes
with the staging folder. A target that exists is replaced in one step. ``sinks.targets`` gives every target to one document; of rows that share one all the same, any is kept whole.

Targets must be absolute, on paths that the driver and all executors share, in the file system of ``path``.
"""

from __future__ import annotations

import itertools
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "target string, content string"
#: Threads of a commit, and the moves that they are handed at a time.
MOVERS, AT_ONCE = 16, 1024


def local_file(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


@dataclass
class Written(WriterCommitMessage):
    """Where a task's list of (staged file, target) is, and how long it is."""

    listed: str
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.staging = f"{local_file(path).rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        mine = f"{self.staging}/{uuid.uuid4().hex}"
        os.makedirs(mine, exist_ok=True)
        files = 0
        with open(f"{mine}/list", "w", encoding="utf-8") as listed:
            for row in iterator:
                staged = f"{mine}/{files}"
                with open(staged, "w", encoding="utf-8", newline="") as out:
                    out.write(row["content"])
                listed.write(json.dumps([staged, local_file(row["target"])]) + "\n")
                files += 1
        return Written(f"{mine}/list", files)

    def commit(self, messages: list[Written | None]) -> None:
        def all_moves() -> Iterator[tuple[str, str]]:
            for message in filter(None, messages):
                with open(message.listed, encoding="utf-8") as lines:
                    yield from map(json.loads, lines)

        def move(pair: tuple[str, str]) -> None:
            os.makedirs(os.path.dirname(pair[1]), exist_ok=True)
            os.replace(*pair)

        with ThreadPoolExecutor(MOVERS) as pool:
            moves = all_moves()
            while some := list(itertools.islice(moves, AT_ONCE)):
                list(pool.map(move, some))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if "path" not in self.options:
            raise ValueError("document_files: the option path names a shared folder")
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)


def write(rows: DataFrame, path: str) -> None:
    """Write ``rows`` (target, content), with ``path`` as the place of the staging folder."""
    register(rows.sparkSession)
    rows.select("target", "content").write.format("document_files").mode("append").option("path", path).save()

"""Folders of documents as rows, in batch and as a stream: names are tested when files are listed, contents only where the name says nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from docblocks import schemas as S
from docblocks.functions import text as T

_BINARY = Y.StructType([Y.StructField("path", Y.StringType()), Y.StructField("modificationTime", Y.TimestampType()), Y.StructField("length", Y.LongType()), Y.StructField("content", Y.BinaryType())])


def suffix_glob() -> str:
    """A glob of all known suffixes, whatever the case of their letters."""
    either = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s[1:])
    return f"*.{{{','.join(either(s) for s in S.SUPPORTED + S.RETIRED)}}}"


def _taken(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("suffix", T.suffix(F.col("name")))
    own = F.contains(F.substring("content", 1, 1024), F.lit(S.OUTPUT_TITLE).cast("binary"))
    taken = rows.where(T.in_scan(F.col("name"))).where(~(F.col("suffix").isin(".html", ".htm") & own))
    return taken.select("path", "name", "suffix", F.col("modificationTime").alias("mtime"), "length", "content")


def raw_documents(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, name, suffix, mtime, length, content) of the files that a scan takes, without the engine's own outputs."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", suffix_glob())
    return _taken(read.load(folder))


def raw_stream(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """The same as a stream of files as they appear."""
    read = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", suffix_glob())
    return _taken(read.load(folder))

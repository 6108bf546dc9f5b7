"""Tables and settings shared by the queries of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; DOCBLOCKS_TOKENIZERS names another folder."""
    folder = os.environ.get("DOCBLOCKS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Folders of stored tables that this process has begun and not cleared.
_open: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared place that spark.checkpoint.dir names.

    Where it is unset, a local master gets a folder of its own, as in tests; on a cluster that is an
    error, since executors would each write to their own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/docblocks-checkpoints"
    _open.append(f"{where.rstrip('/')}/docblocks-{uuid.uuid4().hex}")
    return _open[-1]


def opened() -> list[str]:
    """The folders that operators have begun and nobody has cleared."""
    return list(_open)


def clear(spark: SparkSession, folders: list[str]) -> None:
    """Remove these folders of stored tables: to be called once the results that read them are written."""
    for folder in folders:
        discard(spark, folder)
        if folder in _open:
            _open.remove(folder)


def stored(frame: DataFrame, folder: str, name: str, codec: str = "snappy", rows_per_file: int = 0) -> DataFrame:
    """``frame`` written as Parquet under ``folder`` and read again: the lineage ends there."""
    spark, path = frame.sparkSession, f"{folder}/{name}"
    frame.write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that are no longer used."""
    gc.collect()
    spark._jvm.System.gc()


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key that at least one row in so many has is hot; there are never more such keys than that.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key), null where the key is null or not there.

    ``weight`` is the column of ``table`` that says how many rows have the key; it is dropped. Hot keys are
    broadcast, at most HOT rows, and rows that found theirs are dealt out evenly in the join of the others.
    """
    taken = [*rows.columns, *table.columns]
    found, other, spread = (unused(n, taken) for n in ("found", "other", "spread"))
    values = [c for c in table.columns if c not in (key, weight)]
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT >= total
    packed = table.select(F.col(key).alias(other), F.struct(*values).alias(found), is_hot.alias(spread))
    hot = packed.where(spread).drop(spread)
    first = rows.join(F.broadcast(hot), F.col(key) == F.col(other), "left").drop(other)
    alone = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    first = first.withColumn(spread, F.when(F.col(found).isNotNull() | F.col(key).isNull(), alone).otherwise(F.col(key).cast("string")))
    second = unused("second", [*taken, found, other, spread])
    rest = packed.where(~F.col(spread)).select(F.col(other).cast("string").alias(other), F.col(found).alias(second))
    joined = first.join(rest, F.col(spread) == F.col(other), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col(found), F.col(second))[v].alias(v) for v in values])


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and everything else as it is; only texts beyond ASCII go letter by letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that name a text together."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def remainder(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % n

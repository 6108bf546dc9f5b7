"""Training-data pipeline: quality rules, line dedup, near-duplicate removal, decontamination, encoding.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; all
but the last return the columns of ``documents``.

Odd inputs, in every stage: a row is told apart by its id and its text, so rows under one id or a null
id are judged each for itself; rows that repeat both are judged alike (near dedup keeps one of them);
texts are handled whole; an empty table gives an empty one; further columns pass through, whatever
their names. Null and empty texts: the quality rules reject them; the later stages, called by
themselves, keep them (they hold no line, no shingle, no item, and encode to no ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docblocks.llm import bpe, fertility, lines, setsketch, spaced
from docblocks.llm.tables import clear, discard, opened, read, shared_folder, stored, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep."""
    return fertility.filter_documents(docs, vocabulary("piece_bpe_32k.model"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted; documents of which nothing is left go."""
    out = lines.dedup(docs)
    total, removed = (F.col(f"`{c}`") for c in out.columns[-2:])
    out = out.where((total == 0) | (removed < total))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of least id, stays."""
    return setsketch.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return spaced.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with a digest of what they decode to."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Tokenisation and sketches have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what no later stage reads is removed."""
    folder = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        before = opened()
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, folder, f"stage-{number}")
            clear(spark, [f for f in opened() if f not in before])
            if number:
                discard(spark, f"{folder}/stage-{number - 1}")
    return docs

"""Results to files, reports and JSON; the conversion of a folder, once or as it changes.

The first converted input in order of its path wins a target, whatever the case of its letters and the way it is
written; the others are results with an error. Who wins is decided on names and outcomes alone: neither the contents
of the inputs nor the pages are moved for it. Files are written by the sink "document_files", all of a batch or none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docblocks import pipeline
from docblocks import schemas as S
from docblocks.functions import paths
from docblocks.functions import text as T
from docblocks.operators import reports as G
from docblocks.sources import files as sink
from docblocks.sources import listing
from docblocks.streaming import watch

# Messages (fixed values).
TAKEN = "A saída %s coincide com a de %s. Renomeie um dos dois documentos ou converta-os para pastas diferentes."
ITSELF = "A saída %s é o próprio arquivo de entrada. Escolha outro nome."
MISSING = "Arquivo não encontrado: %s"


def local_path(path: Column) -> Column:
    """A path without its file: scheme."""
    return F.regexp_replace(path, "^file:/*", "/")


def with_target(files: DataFrame, root: str, out_root: str | None = None, body_only: bool = False) -> DataFrame:
    """``files`` (path, name) with the ``target`` that their output gets."""
    folder = watch.target_folder(local_path(F.col("path")), root, out_root) if out_root else F.regexp_replace(local_path(F.col("path")), "[^/]+$", "")
    return files.withColumn("target", F.concat(folder, T.output_name(F.col("name"), body_only)))


def targets(files: DataFrame, root: str, out_root: str | None = None, body_only: bool = False, ok: Column | None = None) -> DataFrame:
    """``files`` (path, name) with ``target``, the ``winner`` of it (the first path that is ``ok``), and what is wrong with it, if anything."""
    ok = F.lit(True) if ok is None else ok
    named = with_target(files, root, out_root, body_only).withColumn("identity", paths.identity(F.col("target")))
    order = Window.partitionBy("identity").orderBy(F.when(ok, 0).otherwise(1), "path")
    first = F.first(F.struct(F.col("path").alias("p"), F.col("name").alias("n"))).over(order)
    named = named.withColumn("first_", first)
    itself = paths.identity(F.col("path")) == F.col("identity")
    taken = ok & (F.col("first_.p") != F.col("path"))
    trouble = F.when(itself, F.format_string(ITSELF, "target")).when(taken, F.format_string(TAKEN, "target", "first_.n"))
    return named.withColumns({"winner": F.col("first_.n"), "trouble": trouble}).drop("first_", "identity")


def _refused(results: DataFrame, wrong: Column) -> DataFrame:
    """``results`` where those in trouble have it as their error and write nothing; an error of their own comes before."""
    bad = wrong.isNotNull()
    errors = F.when(bad & F.col("sucesso"), F.array(wrong)).otherwise(F.col("erros"))
    return results.withColumns({"erros": errors, "arquivos": F.when(bad, F.slice("arquivos", 1, 0)).otherwise(F.col("arquivos")), "sucesso": F.col("sucesso") & ~bad})


def write_files(results: DataFrame, staging: str, target: str = "target") -> int:
    """Write every result's file to its target; returns how many. ``staging`` and the targets are shared by all executors."""
    rows = results.where(F.size("arquivos") > 0).select(F.col(target).alias("target"), F.col("arquivos")[0]["conteudo"].alias("content"))
    sink.write(rows, staging)
    return rows.count()


def report(results: DataFrame) -> DataFrame:
    """One row of totals: documents, converted, failed, with warnings, quotations found, and the exit status (0 if all went well)."""
    ok = F.col("sucesso")
    quotes = F.col("citacoes_por_recuo") + F.col("citacoes_entre_aspas")
    totals = results.agg(
        F.count("*").alias("documents"), F.count_if(ok).alias("converted"), F.count_if(~ok).alias("failed"), F.count_if(F.size("avisos") > 0).alias("with_warnings"),
        F.coalesce(F.sum(quotes), F.lit(0)).alias("quotations"), F.count_if(quotes > 0).alias("with_quotations"), F.count_if(F.col("cabecalho_paragrafos") > 0).alias("with_header"),
    )
    return totals.withColumn("exit_status", F.when((F.col("documents") > 0) & (F.col("failed") == 0), 0).otherwise(1))


def text_report(results: DataFrame, options: pipeline.Options = pipeline.Options()) -> tuple[list[str], DataFrame, list[str]]:
    """The report as text: its first lines, (path, pos, line) of the documents' own in the order of their paths, and the last lines with the totals."""
    quotes = G.quotation_sentence(F.col("citacoes_por_recuo"), F.col("citacoes_entre_aspas"), F.lit(options.quotes))
    header = G.header_sentence(F.size("cabecalho_trechos"), F.lit(options.skip_header))
    lines = G.document_lines(F.col("nome_origem"), F.col("sucesso"), F.col("target"), F.col("avisos"), F.col("erros"), quotes, header)
    total = report(results).first()
    first, last = G.total_lines(total["documents"], total["converted"], total["failed"])
    return first, results.select("path", F.posexplode(lines).alias("pos", "line")).orderBy("path", "pos"), last


def as_json(results: DataFrame) -> DataFrame:
    """(doc_id, json) of every result, all of its fields."""
    key = results.columns[0]
    return results.select(key, F.to_json(F.struct(*[c for c in results.columns if c != key])).alias("json"))


@dataclass
class Batch:
    results: DataFrame
    written: int


def convert_folder(spark: SparkSession, folder: str, out: str | None = None, options: pipeline.Options = pipeline.Options(), recursive: bool = False) -> Batch:
    """Convert the files of a folder; results of files that lost their target have an error and no file."""
    found = pipeline.convert(listing.raw_documents(spark, folder, recursive), options, id_col="path").persist()
    fate = targets(found.select("path", F.col("nome_origem").alias("name"), "sucesso"), folder, out, options.body_only, F.col("sucesso"))
    joined = found.join(fate.select(F.col("path").alias("p_"), "target", "trouble"), F.col("path") == F.col("p_")).drop("p_")
    results = _refused(joined, F.col("trouble")).drop("trouble").persist()  # read by the writer and the caller
    written = write_files(results, out or folder)
    found.unpersist()
    return Batch(results, written)


def contents(files: DataFrame) -> DataFrame:
    """``files`` (path and more) with ``content``, read by the tasks that hold the paths, one file at a time; null where there is none any more."""
    names, where = files.columns, files.columns.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(where).to_pylist()):
                try:
                    with open(sink.local_file(path), "rb") as file:
                        content = file.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([content], pa.binary())], [*names, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(read, f"{schema}, content binary")


def convert_ready(ready: DataFrame, staging: str, options: pipeline.Options = pipeline.Options()) -> Batch:
    """Convert what a watch found ready (path, name, suffix, target, owner) and write it; a target of another path is an error."""
    files = contents(ready).persist()
    found = pipeline.convert(files.where("content is not null"), options, id_col="path")
    none = F.array().cast("array<string>")
    blank = {f.name: F.lit(0).alias(f.name) if f.dataType.simpleString() == "int" else F.array().cast(f.dataType.simpleString()).alias(f.name) for f in found.schema.fields if f.name not in ("path", "nome_origem", "sucesso", "erros")}
    lost = files.where("content is null").select("path", F.col("name").alias("nome_origem"), F.lit(False).alias("sucesso"), F.concat(none, F.array(F.format_string(MISSING, "path"))).alias("erros"), *blank.values())
    fate = ready.select(F.col("path").alias("p_"), "target", "owner")
    joined = found.union(lost.select(*found.columns)).join(fate, F.col("path") == F.col("p_")).drop("p_")
    itself, taken = paths.identity(F.col("path")) == paths.identity(F.col("target")), F.col("owner") != F.col("path")
    trouble = F.when(itself, F.format_string(ITSELF, "target")).when(taken, F.format_string(TAKEN, "target", T.file_name(F.col("owner"))))
    results = _refused(joined, trouble).drop("owner").persist()
    written = write_files(results, staging)
    files.unpersist()
    return Batch(results, written)


def watch_folder(spark: SparkSession, folder: str, checkpoint: str, out: str | None = None, options: pipeline.Options = pipeline.Options(), recursive: bool = False, scans: int | None = None, seconds: float = S.WATCH_SECONDS, then=None) -> StreamingQuery:
    """Convert every file of a folder that is new or changed, once two scans agree on it, until the query is stopped.

    ``then`` is called with the results of every scan that had ready files, and its number.
    """

    def convert(ready: DataFrame, number: int) -> None:
        ready = ready.persist()
        if not ready.isEmpty():
            done = convert_ready(ready, out or folder, options)
            if then is not None:
                then(done, number)
            done.results.unpersist()
        ready.unpersist()

    return watch.start(spark, folder, convert, checkpoint, out, recursive, options.body_only, scans, seconds)

"""Op 9: line dedup by winnowing over line hashes.

A text is the sequence of its lines that have a word; a line's identity is its bytes from the first
word to the last. A window starts at every line and ends where its words reach ``min_words``; the
line of least hash in it (the last on ties) is its fingerprint. Two texts that share a run of lines
with so many words share the run's windows and hence fingerprints: that is the guarantee of
winnowing. A fingerprint carries its window's hash, so that a very common line meets only its equals
in context. For each, the first occurrence by (id, text, position) stays; every other is joined to
it and the match is extended line by line both ways; the run so found is deleted. A deleted line
always has an equal line earlier, so the first copy of every line survives.

The lines that a match can grow by beyond its own windows have fewer than ``min_words`` words, so
those few hashes travel with the window and no text is joined to another.

Results for odd inputs: null and empty texts stay as they are; texts are handled whole; rows that
repeat both id and text are one document and get one result; a null id comes first in order; an
empty table gives no rows; all columns of the input are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import U64, Words, chunks, mix, span_hashes
from .tables import discard, shared_folder, stored, unused

MIN_WORDS = 5
_SCHEMA = "dkey long, dkey2 long, pos int, n int, fingerprint long, window long, head array<long>, tail array<long>"


def line_spans(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
    """(row, start, end, words, hash) of every line with a word."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    first = np.searchsorted(words.starts, starts)
    count = np.diff(np.append(first, len(words)))
    has = count > 0
    first, count, starts = first[has], count[has], starts[has]
    begin, end = words.starts[first], words.ends[first + count - 1]
    row = np.searchsorted(offsets, starts, side="right") - 1
    return row, begin, end, count, span_hashes(words.sums, begin, end)


def windows(row: np.ndarray, count: np.ndarray, hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(first line, lines, fingerprint line, window hash) of every window that is complete."""
    n = len(row)
    total = np.concatenate([[0], np.cumsum(count)])
    end = np.searchsorted(total, total[:-1] + min_words)  # first line after the window
    last_of_row = np.searchsorted(row, row, side="right")
    at = np.flatnonzero((end <= last_of_row) & (end <= n))
    size = end[at] - at
    value, best, where = hashes[at].copy(), hashes[at].copy(), at.copy()
    for k in range(1, int(size.max()) if len(size) else 1):
        more = size > k
        line = at[more] + k
        value[more] = mix(value[more]) + hashes[line]
        lower = hashes[line] <= best[more]
        best[more] = np.where(lower, hashes[line], best[more])
        where[more] = np.where(lower, line, where[more])
    return at, size, where, mix(value + size.astype(U64))


def _context(at: np.ndarray, size: np.ndarray, row: np.ndarray, total: np.ndarray, hashes: np.ndarray, min_words: int) -> tuple[pa.Array, pa.Array]:
    """Hashes of the lines before (nearest first) and after each window, fewer than min_words words of either."""
    signed = hashes.view(np.int64)
    first_of_row = np.searchsorted(row, row[at], side="left")
    last_of_row = np.searchsorted(row, row[at], side="right")
    after = at + size
    stop = np.minimum(np.searchsorted(total, total[after] + min_words) - 1, last_of_row)
    stop = np.maximum(stop, after)
    begin = np.maximum(np.searchsorted(total, total[at] - min_words, side="right"), first_of_row)
    begin = np.minimum(begin, at)

    def lists(start: np.ndarray, length: np.ndarray, step: int) -> pa.Array:
        cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        flat = np.repeat(start, length) + step * (np.arange(cuts[-1]) - np.repeat(cuts[:-1], length))
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed[flat]))

    return lists(at - 1, at - begin, -1), lists(after, stop - after, 1)


def document_keys(id_: Column, text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that name a row by its id and text."""
    return F.xxhash64(id_, text), F.xxhash64(F.lit(1), id_, text)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Windows of all texts with their fingerprints: id, document key, position and context."""
    keys = document_keys(F.col(id_col), F.col(text_col))
    source = docs.select(F.col(id_col).alias("id"), keys[0].alias("dkey"), keys[1].alias("dkey2"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(3)):
                words = Words(data, offsets)
                row, _, _, count, hashes = line_spans(data, offsets, words)
                if not len(row):
                    continue
                at, size, where, value = windows(row, count, hashes, min_words)
                total = np.concatenate([[0], np.cumsum(count)])
                head, tail = _context(at, size, row, total, hashes, min_words)
                begin = np.searchsorted(row, row[at], side="left")
                owner = pa.array(row[at])
                of = [batch.column(i).slice(first, end - first).take(owner) for i in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*of, pa.array((at - begin).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(hashes[where].view(np.int64)), pa.array(value.view(np.int64)), head, tail],
                    ["id", "dkey", "dkey2", "pos", "n", "fingerprint", "window", "head", "tail"],
                )

    return source.mapInArrow(run, f"id {kind}, {_SCHEMA}")


def _common(a: str, b: str) -> str:
    """SQL for the length of the common prefix of two arrays."""
    return f"coalesce(array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false) - 1, 0) + if(array_contains(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false), 0, size({a}) + 1)"


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, folder: str | None = None) -> DataFrame:
    """(dkey, dkey2, runs): for each document with repeats, its runs (start, end) of line positions to delete."""
    folder = folder or shared_folder(docs.sparkSession)
    marks = stored(fingerprints(docs, id_col, text_col, min_words), folder, "fingerprints")
    place = F.struct("id", "dkey", "dkey2", "pos")
    firsts = marks.groupBy("fingerprint", "window").agg(F.min(place).alias("first"), F.count("*").alias("c"), F.min_by(F.struct("head", "tail"), place).alias("ctx"))
    firsts = stored(firsts.where("c > 1").drop("c"), folder, "firsts")
    later = marks.join(firsts.withColumnsRenamed({"fingerprint": "f", "window": "w"}), (F.col("fingerprint") == F.col("f")) & (F.col("window") == F.col("w")))
    later = later.where((F.col("dkey") != F.col("first.dkey")) | (F.col("dkey2") != F.col("first.dkey2")) | (F.col("pos") != F.col("first.pos")))
    run = later.select(
        "dkey",
        "dkey2",
        F.expr(f"cast(pos - ({_common('head', 'ctx.head')}) as int)").alias("start"),
        F.expr(f"cast(pos + n + ({_common('tail', 'ctx.tail')}) as int)").alias("end"),
    )
    return run.groupBy("dkey", "dkey2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"))


def _without(text: str, spans: list[dict]) -> tuple[str, int]:
    """The text without the lines of these runs, and how many went."""
    parts = text.split("\n")
    full = [i for i, p in enumerate(parts) if p.encode().split()]
    gone = {full[i] for s in spans for i in range(max(0, s["start"]), min(len(full), s["end"]))}
    return "\n".join(p for i, p in enumerate(parts) if i not in gone), len(gone)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the repeated runs gone from the text, then its lines and how many of them went.

    Those two columns are named n_lines and n_lines_removed, with underscores behind where ``docs`` has such columns.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    runs = stored(repeated_runs(docs, id_col, text_col, min_words, folder), folder, "runs")
    discard(spark, f"{folder}/fingerprints")
    discard(spark, f"{folder}/firsts")
    k1, k2, spans = (unused(n, docs.columns) for n in ("k1", "k2", "runs"))
    named = document_keys(F.col(id_col), F.col(text_col))
    joined = docs.join(runs.toDF(k1, k2, spans), (named[0] == F.col(k1)) & (named[1] == F.col(k2)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], spans)
    where = docs.columns.index(text_col)
    names = [*docs.columns, unused("n_lines", docs.columns), unused("n_lines_removed", docs.columns)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {names[-2]} int, {names[-1]} int"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(where)):
                part = batch.slice(first, end - first)
                counts = np.bincount(line_spans(data, offsets, Words(data, offsets))[0], minlength=end - first)
                removed = np.zeros(end - first, dtype=np.int64)
                spans, columns = part.column(part.num_columns - 1), list(part.columns[:-1])
                cut = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
                if len(cut):
                    texts = columns[where].to_pylist()
                    for i in cut.tolist():
                        texts[i], removed[i] = _without(texts[i], spans[i].as_py())
                    columns[where] = pa.array(texts, type=columns[where].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.astype(np.int32)), pa.array(removed.astype(np.int32))], names)

    return joined.mapInArrow(rebuild, schema)

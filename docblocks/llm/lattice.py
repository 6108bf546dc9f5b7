"""Op 5: language-model scoring by a subword lattice.

A word's probability is the sum over all its segmentations into pieces of a public vocabulary, by a
forward recursion in log space: a(0) = 0 and a(j) = logsum over pieces w[i:j] of a(i) + log p(piece).
A text is the product over its words and one end each, so its score is the log10 of a marginal
probability, not of one best segmentation.

The vocabulary's own scores are the start: they order pieces, and p falls as a power of the rank.
The training corpus then weighs them: every training word adds, as often as it occurs, the expected
uses of each piece given the word (forward-backward), and expected uses plus PRIOR_WEIGHT times the
start give p. The vocabulary itself is never changed, so what reaches the driver is one number for
each of its pieces. Words are cut by ``[^\\x20\\x09-\\x0D]+`` and lower-cased (A-Z), pieces likewise and
without the vocabulary's word-start mark; bytes that no piece covers are pieces of their own.

The lattice alone gives the score of every word, seen in training or not; whole-word counts make the
base score only. All probabilities of words and of the end sum to one.

The corpus counts of all words are a distributed table. Documents are dealt into blocks of bounded
bytes; a block's distinct words are joined with the counts, and block and words come together again
to score the texts. So a word is looked up once for each block, however often it occurs.

Results for odd inputs: null and empty texts are the end alone (one token); rows that repeat an id
are scored each; a null id is held out of training; an empty table gives no rows; further columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import Words, chunks, held, prefix_sums, ragged, span_hashes, string_bytes
from .tables import discard, release, shared_folder, stored

#: A vocabulary with a piece of more bytes is refused, as stretches carry values over a piece's length only.
LONGEST = 1 << 10
#: Weight of the vocabulary's own distribution, in expected uses.
PRIOR_WEIGHT = 2000.0
#: Longer words are worked through in stretches of so many bytes; no segmentation is lost at their borders.
STRETCH = 1 << 14
#: Bytes of the words of one lattice.
LATTICE_BYTES = 1 << 18
#: Text bytes of a block.
BLOCK_BYTES = 12 << 20
SMOOTH = 0.1
WORDS_PER_FILE = 60_000
#: Text bytes whose words are counted at once.
COUNT_BYTES = 1 << 20


class Pieces:
    """Pieces of a vocabulary by the hash of their bytes, with log probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i).replace("▁", "").lower().encode()
            if piece:
                found[piece] = max(found.get(piece, -np.inf), model.get_score(i))
        for b in range(256):
            found.setdefault(bytes([b]), -1e6)
        pieces = sorted(found, key=lambda p: (-found[p], p))
        self.lengths = sorted({len(p) for p in pieces})
        self.longest = self.lengths[-1]
        if self.longest > LONGEST:
            raise ValueError(f"{path}: a piece has {self.longest} bytes, more than {LONGEST}")
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        hashes = span_hashes(prefix_sums(data), ends - np.array([len(p) for p in pieces]), ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.size = len(pieces)
        start = 1.0 / (np.arange(self.size) + 10.0)
        self.start = start / start.sum()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where there's no such piece."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def pieces_of(path: str) -> Pieces:
    """One for each worker and file."""
    own = held("lattice")
    if path not in own:
        own[path] = Pieces(path)
    return own[path]


def log_p(pieces: Pieces, uses: np.ndarray | None, stop: float) -> np.ndarray:
    """Log probabilities of the pieces; ``stop`` is the share of the word's end among all symbols."""
    weight = pieces.start * PRIOR_WEIGHT + (uses if uses is not None else 0)
    return np.log(weight / weight.sum()) + np.log1p(-stop)


class Lattice:
    """All pieces that start in some stretches: arcs (from, to, piece) by the level of their end.

    A stretch is bytes starts to ends of a word that goes on to ``limits``; its nodes are the places 0 to
    ends - starts and those beyond that its last pieces reach, ``more`` of them.
    """

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limits: np.ndarray | None = None):
        sums = prefix_sums(data)
        limits = ends if limits is None else limits
        self.length = ends - starts
        self.more = np.minimum(limits - ends, pieces.longest - 1)
        self.n = len(starts)
        self.base = np.concatenate([[0], np.cumsum(self.length + self.more + 1)])  # node 0 of each stretch
        word = np.repeat(np.arange(self.n), self.length)
        place = ragged(np.zeros(self.n, np.int64), self.length)
        at, left = starts[word] + place, (limits - starts)[word] - place
        node = self.base[word] + place
        source, piece, size = [], [], []
        for k in pieces.lengths:
            fits = np.flatnonzero(left >= k)
            if not len(fits):
                break
            found = pieces.find(span_hashes(sums, at[fits], at[fits] + k))
            hit = found >= 0
            source.append(fits[hit]), piece.append(found[hit]), size.append(np.full(int(hit.sum()), k))
        which = np.concatenate(source) if source else np.zeros(0, np.int64)
        self.piece = np.concatenate(piece) if piece else np.zeros(0, np.int64)
        sizes = np.concatenate(size) if size else np.zeros(0, np.int64)
        self.source, self.owner, self.level = node[which], word[which], place[which]
        self.target = self.source + sizes
        reach = self.level + sizes
        order = np.lexsort((self.target, reach))
        self.source, self.target, self.piece, self.owner, self.level = (x[order] for x in (self.source, self.target, self.piece, self.owner, self.level))
        self.cuts = np.flatnonzero(np.diff(reach[order], prepend=-1, append=-1))

    def forward(self, logp: np.ndarray, carried: np.ndarray | None = None) -> np.ndarray:
        """Log of the summed probability of all paths to each node; ``carried`` has a start for each node."""
        a = np.full(self.base[-1], -np.inf) if carried is None else carried.copy()
        if carried is None:
            a[self.base[:-1]] = 0.0
        for low, high in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            np.logaddexp.at(a, self.target[low:high], a[self.source[low:high]] + logp[self.piece[low:high]])
        return a

    def backward(self, logp: np.ndarray, carried: np.ndarray | None = None) -> np.ndarray:
        """Log of the summed probability of all paths from each node to its word's end."""
        z = np.full(self.base[-1], -np.inf) if carried is None else carried.copy()
        if carried is None:
            z[self.base[1:] - 1] = 0.0
        order = np.argsort(-self.level, kind="stable")
        cuts = np.flatnonzero(np.diff(self.level[order], prepend=-1, append=-1))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            o = order[low:high]
            np.logaddexp.at(z, self.source[o], logp[self.piece[o]] + z[self.target[o]])
        return z

    def totals(self, a: np.ndarray) -> np.ndarray:
        return a[self.base[1:] - 1]


def _groups(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, bytes, starts, ends): those of at most STRETCH bytes by length, in groups of bounded bytes."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    order = order[: np.searchsorted(sizes[order], STRETCH, side="right")]
    group = np.cumsum(sizes[order]) // LATTICE_BYTES
    for at in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        if len(at):
            ends = np.cumsum(sizes[at])
            yield at, np.frombuffer(b"".join(words[i] for i in at), dtype=np.uint8), ends - sizes[at], ends


def _part(pieces: Pieces, word: bytes, start: int) -> Lattice:
    """The stretch of a long word from ``start``, with the bytes that its last pieces reach."""
    data = np.frombuffer(word, dtype=np.uint8)[start : start + STRETCH + pieces.longest - 1]
    one = np.zeros(1, np.int64)
    return Lattice(pieces, data, one, one + min(STRETCH, len(data)), one + len(data))


def _forward_parts(pieces: Pieces, logp: np.ndarray, word: bytes) -> tuple[list[np.ndarray], float]:
    """The values that each stretch of a long word starts with, and the log of the sum over its paths."""
    begin, starts = np.zeros(1), []
    for start in range(0, len(word), STRETCH):
        lattice = _part(pieces, word, start)
        starts.append(begin)
        a = lattice.forward(logp, _filled(lattice, begin, 0))
        begin = a[lattice.length[0] :]
    return starts, float(begin[0])


def _filled(lattice: Lattice, values: np.ndarray, at: int) -> np.ndarray:
    """Values from node ``at`` on, and no path elsewhere."""
    out = np.full(lattice.base[-1], -np.inf)
    out[at : at + len(values)] = values
    return out


def word_log_probs(pieces: Pieces, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log of the marginal probability of each word's bytes."""
    out = np.zeros(len(words))
    for at, data, starts, ends in _groups(words):
        lattice = Lattice(pieces, data, starts, ends)
        out[at] = lattice.totals(lattice.forward(logp))
    for i, word in enumerate(words):
        if len(word) > STRETCH:
            out[i] = _forward_parts(pieces, logp, word)[1]
    return out


def expected_uses(pieces: Pieces, logp: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over words with counts."""
    uses = np.zeros(pieces.size)

    def add(lattice: Lattice, a: np.ndarray, z: np.ndarray, totals: np.ndarray, n: np.ndarray) -> None:
        share = np.exp(a[lattice.source] + logp[lattice.piece] + z[lattice.target] - totals[lattice.owner])
        np.add(uses, np.bincount(lattice.piece, weights=share * n[lattice.owner], minlength=pieces.size), out=uses)

    for at, data, starts, ends in _groups(words):
        lattice = Lattice(pieces, data, starts, ends)
        a = lattice.forward(logp)
        add(lattice, a, lattice.backward(logp), lattice.totals(a), counts[at])
    for i, word in enumerate(words):
        if len(word) > STRETCH:
            begins, total = _forward_parts(pieces, logp, word)
            end = np.zeros(1)  # values from the stretch's last node on
            for k in range(len(begins) - 1, -1, -1):
                lattice = _part(pieces, word, k * STRETCH)
                a = lattice.forward(logp, _filled(lattice, begins[k], 0))
                z = lattice.backward(logp, _filled(lattice, end[: lattice.more[0] + 1], int(lattice.length[0])))
                add(lattice, a, z, np.array([total]), counts[i : i + 1])
                end = z
    return uses


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(data, offsets, lower=True)
    _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return words, first, which


def _word_bytes(words: Words, at: np.ndarray) -> pa.Array:
    sizes = words.ends[at] - words.starts[at]
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(words.data[ragged(words.starts[at], sizes)]))])


def block_words(blocks: DataFrame) -> DataFrame:
    """(block, word, h, t): words of pieces of a block with their hashes and counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for first, end, data, at in chunks(batch.column(2), COUNT_BYTES):
                cuts = np.flatnonzero(np.append(True, block[first + 1 : end] != block[first : end - 1]))
                for low, high in zip(cuts, np.append(cuts[1:], end - first), strict=True):
                    words, where, which = _distinct(data[at[low] : at[high]], at[low : high + 1] - at[low])
                    hashes = words.hashes()[where]
                    train = np.bincount(which, weights=learn[first + low : first + high][words.row], minlength=len(where))
                    n = len(where)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block[first + low], dtype=np.int64)), _word_bytes(words, where), pa.array(hashes.view(np.int64)), pa.array(train.astype(np.int64))], ["block", "word", "h", "t"])

    return blocks.select("block", "learn", "text").mapInArrow(run, "block long, word binary, h long, t long")


def score(docs: DataFrame, learn: Column, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """(id, learn, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn`` marks what may be learnt from."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # blocks are runs of rows of a partition, closed when their bytes reach BLOCK_BYTES
    kind = source.schema["id"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled = 0, 0
        for batch in batches:
            sizes = np.diff(string_bytes(batch.column(3))[1])
            out = np.empty(batch.num_rows, dtype=np.int64)
            part = batch.column(0).to_numpy()
            for i, s in enumerate(sizes.tolist()):
                if filled and filled + s > BLOCK_BYTES:
                    number, filled = number + 1, 0
                filled += s
                out[i] = (int(part[i]) << 24) + number
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns[1:]], ["block", "id", "learn", "text"])

    blocks = source.select(F.spark_partition_id().cast("long").alias("p"), "id", "learn", "text").mapInArrow(dealt, f"block long, id {kind}, learn boolean, text string")
    blocks = stored(blocks, folder, "blocks", "zstd")
    found = block_words(blocks).groupBy("block", "word").agg(F.min("h").alias("h"), F.sum("t").alias("t"))
    found = stored(found, folder, "words", "zstd")
    every = found.groupBy("word").agg(F.sum("t").alias("n"))
    every = stored(every, folder, "counts", "zstd", WORDS_PER_FILE)  # small files: what takes time a row is dealt by rows
    release(spark)
    counts = every.where("n > 0")
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    texts = blocks.where("learn").count()
    n_train, vocabulary = int(total[0]) + texts, int(total[1]) + (texts > 0)

    pieces = pieces_of(path)
    words = int(total[0])
    uses: np.ndarray | None = None
    stop = 0.25
    for _ in range(rounds):
        logp = log_p(pieces, uses, stop)

        def expect(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            own, sums = pieces_of(path), None
            for batch in batches:
                for low in range(0, batch.num_rows, 20_000):
                    part = batch.slice(low, 20_000)
                    got = expected_uses(own, logp, part.column(0).to_pylist(), part.column(1).to_numpy().astype(float))
                    sums = got if sums is None else sums + got
            if sums is not None:
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["piece", "uses"])

        # one row for each piece of the vocabulary: bounded whatever the corpus
        rows = counts.mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(pieces.size)
        for r in rows:
            uses[r[0]] = r[1]
        # a word's end among all symbols: one for each word, against the expected pieces
        stop = words / (words + float(uses.sum())) if words else stop
    logp = log_p(pieces, uses, stop)
    ends = texts / n_train if words else 0.5  # texts without a word say nothing of words
    other = float(np.log(stop) + np.log1p(-ends))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 20_000):
                part = batch.slice(low, 20_000)
                lm = word_log_probs(own, logp, part.column(0).to_pylist()) + other
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lm / np.log(10))], ["w", "n", "lm"])

    weighed = stored(every.mapInArrow(weigh, "w binary, n long, lm double"), folder, "weighed", "zstd")
    discard(spark, f"{folder}/counts")
    release(spark)
    # from here on a word is its hash: blocks look up their own words only
    looked = stored(found.join(weighed, F.col("word") == F.col("w")).select("block", "h", "n", "lm"), folder, "looked", "zstd")
    discard(spark, f"{folder}/words")
    discard(spark, f"{folder}/weighed")
    release(spark)
    # a task for each block or two, whatever the session's number of partitions
    n_blocks = blocks.select("block").distinct().count()
    tasks = max(2 * n_blocks, 1)
    end_base = float(np.log10((texts + SMOOTH) / (n_train + SMOOTH * (vocabulary + 1))))

    def join(key: tuple, left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, model, known = [], [], [], []
        for batch in right:
            n = batch.column(2).to_numpy().astype(float)
            hashes.append(batch.column(1).to_numpy().view(np.uint64))
            base.append(np.log10((n + SMOOTH) / (n_train + SMOOTH * (vocabulary + 1))))
            model.append(batch.column(3).to_numpy())
            known.append(n > 0)
        order = None
        if hashes:
            h, b, m, k = (np.concatenate(x) for x in (hashes, base, model, known))
            order = np.argsort(h)
            h, b, m, k = h[order], b[order], m[order], k[order]
        for batch in left:
            for first, end, data, at in chunks(batch.column(3)):
                words = Words(data, at, lower=True)
                rows = end - first
                n = np.diff(words.first)
                if len(words):
                    place = np.searchsorted(h, words.hashes())
                    sums = [np.bincount(words.row, weights=x[place], minlength=rows) for x in (b, m, k)]
                else:
                    sums = [np.zeros(rows)] * 3
                known_end = int(texts > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(first, rows),
                        batch.column(2).slice(first, rows),
                        pa.array(n + 1),
                        pa.array(sums[2].astype(np.int64) + known_end),
                        pa.array(np.full(rows, n_train, dtype=np.int64)),
                        pa.array(sums[0] + end_base),
                        pa.array(sums[1] + float(np.log10(ends))),
                    ],
                    ["id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = blocks.repartition(tasks, "block").groupBy("block").cogroup(looked.repartition(tasks, "block").groupBy("block")).applyInArrow(_whole(join), f"id {kind}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def _whole(join):
    """``join`` over whole tables of one block each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(join((), iter(left.combine_chunks().to_batches()), iter(right.combine_chunks().to_batches())))
        return pa.Table.from_batches(parts)

    return run


__all__ = ["Lattice", "Pieces", "expected_uses", "score", "word_log_probs"]

"""Op 3: exact removal of long repeats by a logarithmic family of sparse suffix arrays.

Every byte that a ``span``-byte string covers which also starts anywhere else is removed. Suffixes
are indexed only where the least hash of GRAM-byte grams of some ``span``-byte window stands, so
equal windows hold an indexed suffix at the same place (a minimizer), one in about 70 bytes.

1. Indexed grams that occur once are dropped: the windows that hold them occur once too.
2. Each suffix left is its gram with the bytes before and after it that a window can reach (its
   context). Suffixes of equal contexts are one entry that is known to repeat as a whole.
3. Entries are dealt by range of their order and indexed batch by batch: a new batch is sorted (its
   suffix array), merge-scanned against every existing level for its neighbours there, and becomes a
   level; levels of like size merge, so there are few. A neighbour with r common bytes after and l
   before the gram shows windows at offsets span - GRAM - r to l to be repeats. This is done in the
   order of the bytes after the gram, then in the order of those before it.
4. No window can begin further left than the longest common left context, nor end further right
   than the right one. What lies within both limits and no neighbour has shown is settled at once by
   counting those windows in the range (an exact check after the scan). A gram of up to WHOLE
   entries stands in one range. The entries of more common ones may fill many: those that the borders
   of ranges split have their windows counted over all ranges.
5. Windows become byte runs, runs of a text are united, and its other bytes are kept.

Texts that are equal as a whole are indexed once; those that occur twice or more and have ``span``
bytes are removed whole. Positions are judged on the input, never on what is left.

Results for odd inputs: null and empty texts have 0 bytes; texts shorter than ``span`` are kept;
repeats inside one text count; rows that repeat id and text are equal texts; an empty table gives no
rows; further columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import FAMILIES, U64, power_table, chunks, give_back, mix, prefix_sums, ragged, span_hashes
from .tables import discard, release, shared_folder, stored

SPAN = 200
GRAM = 64
#: Entries sorted as one batch.
BATCH = 20_000
#: A gram with no more entries than this goes into one range as a whole; at 283 bytes an entry, 14 MB.
WHOLE = 50_000


#: Odd factors of the hashes below.
_MIX = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


def _sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    out, size = values, 1
    while 2 * size <= width:
        out = op(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return op(out[:n], out[width - size : width - size + n])


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    n = len(data) - 7
    out = np.empty(n, dtype="<u8")
    for k in range(8):
        at = out[k::8]
        at[:] = data[k : k + 8 * len(at)].view("<u8")
    return out


def samples(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, gram hash) of the indexed suffixes of texts laid end to end.

    The order that picks a window's place hashes a gram's first eight bytes; equal windows pick alike.
    """
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    loads = _loads(data)
    ranks = loads[: len(data) - gram + 1] * _MIX[0]
    ranks ^= ranks >> U64(32)
    ranks *= _MIX[1]
    ranks = np.maximum((ranks >> U64(32)).astype(np.uint32), np.uint32(1))
    width = span - gram + 1
    least = _sliding(ranks, width, np.minimum)
    # windows that begin in one text and end in another don't count
    crossing = np.zeros(len(data) + 1, dtype=np.int32)
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    np.add.at(crossing, np.maximum(cuts - span + 1, 0), 1)
    np.add.at(crossing, cuts, -1)
    least[np.cumsum(crossing)[: len(least)] > 0] = 0
    pad = np.zeros(width - 1, dtype=np.uint32)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((most == ranks) & (most > 0))
    return at, _gram_hash(loads, at, gram)


def _gram_hash(loads: np.ndarray, at: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of the ``gram`` bytes from each place on."""
    out = np.zeros(len(at), dtype=U64)
    for k in range(0, gram, 8):
        out = (out ^ loads[at + k]) * _MIX[2]
        out ^= out >> U64(29)
    return mix(out)


def _sampled(docs: DataFrame) -> DataFrame:
    """(tkey, pos, gram) of the indexed suffixes of (tkey, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                at, grams = samples(data, offsets)
                row = np.searchsorted(offsets, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).take(pa.array(row)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(grams.view(np.int64))], ["tkey", "pos", "gram"])

    return docs.mapInArrow(run, "tkey long, pos int, gram long")


def _contexts(texts: DataFrame) -> DataFrame:
    """A record for each chosen position of (tkey, second, text, at): its context's two keys, its gram and the bytes around.

    ``before`` runs leftwards.
    """
    reach = SPAN - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            counts = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
            places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(counts) - counts
            for first, end, data, offsets in chunks(batch.column(2)):
                n = counts[first:end]
                pos = places[begin[first] : begin[first] + int(n.sum())]
                row = np.repeat(np.arange(end - first), n)
                at = offsets[row] + pos
                fits = at + GRAM <= offsets[row + 1]
                pos, row, at = pos[fits], row[fits], at[fits]
                if not len(at):
                    continue
                left = np.minimum(pos, reach)
                right = np.minimum(offsets[row + 1] - at - GRAM, reach)
                gram = _gram_hash(_loads(data), at)
                keys = []
                for family in (0, 1):
                    sums = prefix_sums(data, family)
                    b = span_hashes(sums, at - left, at, family)
                    a = span_hashes(sums, at, at + GRAM + right, family)
                    keys.append(mix(a * _MIX[0] + (b ^ (b >> U64(29))) * _MIX[1]))
                turned = data[::-1]

                def cut(start: np.ndarray, size: np.ndarray, source: np.ndarray) -> pa.Array:
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(source[ragged(start, size)]))])

                of = [batch.column(i).slice(first, end - first).take(pa.array(row)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(k.view(np.int64)) for k in keys], *of, pa.array(pos.astype(np.int32)), pa.array(gram.view(np.int64)), cut(len(data) - at, left, turned), cut(at + GRAM, right, data)],
                    ["ctx", "ctx2", "tkey", "second", "pos", "gram", "before", "after"],
                )

    return texts.mapInArrow(run, "ctx long, ctx2 long, tkey long, second long, pos int, gram long, before binary, after binary")


class Entries:
    """Entries of a range as fixed-width rows: gram, the side that orders, the other side."""

    def __init__(self, reach: int):
        self.reach = reach
        self.rows = np.zeros((0, 8 + 2 * reach + 3), dtype=np.uint8)

    def pack(self, grams: np.ndarray, first: pa.Array, second: pa.Array) -> np.ndarray:
        """Rows whose bytes sort like (gram, first side and its length, second side and its length)."""
        out = np.zeros((len(grams), 8 + 2 * self.reach + 3), dtype=np.uint8)
        # the sign bit turned, so that bytes sort like the signed numbers by which Spark deals ranges
        out[:, :8] = (grams.astype(np.int64).view(U64) ^ U64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
        for column, begin in ((first, 8), (second, 9 + self.reach)):
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            flat = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
            size = np.diff(at)
            place = ragged(np.zeros(len(size), np.int64), size)
            out[np.repeat(np.arange(len(size)), size), begin + place] = flat[at[0] : at[-1]]
            out[:, begin + self.reach] = size
        out[:, -1] = 1
        return out


def _common(a: np.ndarray, b: np.ndarray, begin: int, reach: int) -> np.ndarray:
    """Common bytes of one side of two lots of rows."""
    size = np.minimum(a[:, begin + reach], b[:, begin + reach]).astype(np.int64)
    differ = a[:, begin : begin + reach] != b[:, begin : begin + reach]
    found = np.where(differ.any(1), differ.argmax(1), reach)
    return np.minimum(found, size)


class SuffixLevels:
    """The logarithmic family: sorted levels of growing size, and what neighbours have shown so far."""

    def __init__(self, reach: int):
        self.reach = reach
        self.rows: list[np.ndarray] = []
        self.n = 0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.most: list[tuple[np.ndarray, np.ndarray]] = []

    def _match(self, i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> None:
        same = (a[:, :8] == b[:, :8]).all(1)
        i, a, j, b = i[same], a[same], j[same], b[same]
        if not len(i):
            return
        one = _common(a, b, 8, self.reach)
        two = _common(a, b, 9 + self.reach, self.reach)
        for who in (i, j):
            self.most.append((who, one))
        good = one + two >= self.reach
        for who in (i[good], j[good]):
            self.found.append((who, one[good], two[good]))

    def add(self, rows: np.ndarray) -> None:
        """Sort a batch, scan it against the levels, put it among them."""
        width = rows.shape[1]
        as_keys = lambda x: np.ascontiguousarray(x).view(f"S{width}").ravel()
        ids = np.arange(self.n, self.n + len(rows))
        self.n += len(rows)
        order = np.argsort(as_keys(rows), kind="stable")
        rows, ids = rows[order], ids[order]
        self._match(ids[:-1], rows[:-1], ids[1:], rows[1:])
        keys = as_keys(rows)
        for level, who in self.levels:
            place = np.searchsorted(as_keys(level), keys)
            low = np.flatnonzero(place > 0)
            self._match(ids[low], rows[low], who[place[low] - 1], level[place[low] - 1])
            high = np.flatnonzero(place < len(level))
            self._match(ids[high], rows[high], who[place[high]], level[place[high]])
        self.levels.append((rows, ids))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            (a, i), (b, j) = self.levels.pop(), self.levels.pop()
            both, who = np.concatenate([b, a]), np.concatenate([j, i])
            order = np.argsort(as_keys(both), kind="stable")  # two runs: a merge
            self.levels.append((both[order], who[order]))


_SCAN = "ctx long, ctx2 long, lo int, hi int, border long"
_CTX = ["ctx", "ctx2"]


def _turned(rows: np.ndarray, reach: int) -> np.ndarray:
    """Rows with their two sides exchanged."""
    return np.concatenate([rows[:, :8], rows[:, 9 + reach : 10 + 2 * reach], rows[:, 8 : 9 + reach], rows[:, -1:]], axis=1)


def _limits(family: SuffixLevels, n: int) -> np.ndarray:
    """The longest common first side that each row has with any other of its gram, -1 without one."""
    most = np.full(n, -1, dtype=np.int64)
    for who, one in family.most:
        np.maximum.at(most, who, one)
    return most


def _settled(rows: np.ndarray, group: np.ndarray, needed: np.ndarray, reach: int) -> np.ndarray:
    """Of the windows (row, offset) that are needed, those that another row of the group has too.

    Two running hashes of the bytes before and after are carried from offset to offset.
    """
    out = np.zeros_like(needed)
    after, before = rows[:, 8 : 8 + reach], rows[:, 9 + reach : 9 + 2 * reach]
    powers = [power_table(base, reach) for _, base, _ in FAMILIES]
    left = [np.zeros(len(rows), dtype=U64) for _ in FAMILIES]
    right = [(values[after] * power).sum(axis=1, dtype=U64) for (values, _, _), power in zip(FAMILIES, powers, strict=True)]
    salt = mix(group.astype(U64) + U64(1))
    for o in range(reach + 1):
        at = np.flatnonzero(needed[:, o])
        if len(at):
            one, two = (mix(x[at] * _MIX[0] ^ mix(y[at] + salt[at])) for x, y in zip(left, right, strict=True))
            order = np.argsort(one, kind="stable")
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            hit = np.zeros(len(at), dtype=bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            out[at, o] = hit
        if o < reach:
            for k, (values, _, _) in enumerate(FAMILIES):
                left[k] += values[before[:, o]] * powers[k][o]
                right[k] -= values[after[:, reach - 1 - o]] * powers[k][reach - 1 - o]
    return out


def _covered(rows: np.ndarray, multi: np.ndarray, first: SuffixLevels, second: SuffixLevels, reach: int) -> np.ndarray:
    """(row, offset) of the windows that repeat in these rows: shown by neighbours of either order, or settled."""
    n = len(rows)
    edge = np.zeros((n, reach + 2), dtype=np.int16)
    for family, swapped in ((first, False), (second, True)):
        for who, one, two in family.found:
            after, before = (two, one) if swapped else (one, two)
            np.add.at(edge, (who, reach - after), 1)
            np.add.at(edge, (who, before + 1), -1)
    cover = np.cumsum(edge, axis=1, dtype=np.int16)[:, : reach + 1] > 0
    offsets = np.arange(reach + 1)
    inside = (offsets >= (reach - _limits(first, n))[:, None]) & (offsets <= _limits(second, n)[:, None])
    open_ = inside & ~cover & ~multi[:, None]
    _, group = np.unique(np.ascontiguousarray(rows[:, :8]).view(">u8").ravel(), return_inverse=True)
    some = np.flatnonzero(np.bincount(group, weights=open_.any(1), minlength=int(group.max()) + 1)[group] > 0)
    if len(some):
        # all rows of a gram whose limits hold an offset that one of them asks for
        place, mine = np.unique(group[some], return_inverse=True)
        asked = np.zeros((len(place), reach + 1), dtype=bool)
        np.logical_or.at(asked, mine, open_[some])
        cover[some] |= _settled(rows[some], mine, inside[some] & asked[mine], reach) & open_[some]
    return cover


def _scan(entries: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Windows that repeat in a range, as rows (ctx, ctx2, lo, hi) of offsets, and the grams at its borders."""
    reach = SPAN - GRAM
    common = entries.groupBy("gram").count().where(F.col("count") > whole).select(F.col("gram").alias("gram_"))
    rows = entries.select(*_CTX, "multi", "gram", "after", "before").join(F.broadcast(common), _on("gram"), "left")
    # only a common gram's entries are dealt by what stands around it
    dealt = rows.repartitionByRange("gram", *[F.when(F.col("gram_").isNotNull(), F.col(c)) for c in ("after", "before")]).drop("gram_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families, packer = (SuffixLevels(reach), SuffixLevels(reach)), Entries(reach)
        names, packed, multis, grams = [], [], [], []
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                names.append(np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()]))
                multis.append(part.column(2).to_numpy(zero_copy_only=False))
                grams.append(part.column(3).to_numpy())
                packed.append(packer.pack(grams[-1], part.column(4), part.column(5)))
                families[0].add(packed[-1])
                families[1].add(_turned(packed[-1], reach))
        if not names:
            return
        ctx, rows = np.concatenate(names, axis=1), np.concatenate(packed)
        for family in families:
            family.levels.clear()
        cover = _covered(rows, np.concatenate(multis), *families, reach)
        step = np.diff(cover.astype(np.int8), axis=1, prepend=0, append=0)
        who, lo = np.nonzero(step == 1)
        hi = np.nonzero(step == -1)[1] - 1
        for low in range(0, len(who), 100_000):
            w = who[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ctx[0, w]), pa.array(ctx[1, w]), *[pa.array(x[low : low + 100_000].astype(np.int32)) for x in (lo, hi)], pa.nulls(len(w), pa.int64())], [*_CTX, "lo", "hi", "border"])
        every = np.concatenate(grams)
        ends = pa.array(sorted({int(every.min()), int(every.max())}), pa.int64())
        none = [pa.nulls(len(ends), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, ends], [*_CTX, "lo", "hi", "border"])
        give_back()

    return dealt.mapInArrow(run, _SCAN)


def _named(frame: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` with an underscore behind, for joins."""
    return frame.withColumnsRenamed({n: f"{n}_" for n in names})


def _on(*names: str) -> Column:
    """Equality of each name and the same with an underscore behind."""
    return functools.reduce(Column.__and__, [F.col(n) == F.col(f"{n}_") for n in names])


def repeated_bytes(docs: DataFrame, copies: DataFrame, folder: str, whole: int = WHOLE) -> DataFrame:
    """(tkey, second, runs) for the texts of (id, tkey, second, text) that hold repeats: runs (start, end) of bytes.

    ``copies`` names the row (rep) whose text stands for all equal ones.
    """
    spark = docs.sparkSession
    reach = SPAN - GRAM
    marks = stored(_sampled(docs.where(F.octet_length("text") >= SPAN).select("tkey", "text")), folder, "samples", "zstd")
    place = F.xxhash64("tkey", "pos")
    twice = marks.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select(F.col("gram").alias("gram_"))
    twice = stored(twice, folder, "grams")
    release(spark)
    chosen = marks.join(twice, _on("gram")).groupBy("tkey").agg(F.collect_set("pos").alias("at"))
    wanted = chosen.join(_named(copies.select("tkey", "second", "rep"), "tkey"), _on("tkey")).select(F.col("tkey").alias("tkey_"), F.col("second").alias("second_"), "rep", "at")
    wanted = stored(wanted, folder, "chosen", "zstd")
    discard(spark, f"{folder}/samples")
    discard(spark, f"{folder}/grams")
    release(spark)
    texts = docs.join(wanted, _on("tkey", "second") & F.col("id").eqNullSafe(F.col("rep"))).select("tkey", "second", "text", "at")
    records = stored(_contexts(texts), folder, "contexts", "zstd")
    discard(spark, f"{folder}/chosen")
    release(spark)

    place = F.xxhash64("tkey", "second", "pos")
    alike = [F.first(c).alias(c) for c in ("gram", "before", "after")]  # equal wherever both keys are
    entries = records.groupBy(*_CTX).agg(*alike, (F.min(place) != F.max(place)).alias("multi"))
    entries = stored(entries, folder, "entries", "zstd")
    places = stored(records.select(*_CTX, "tkey", "second", "pos"), folder, "places", "zstd")
    discard(spark, f"{folder}/contexts")
    release(spark)

    scan = stored(_scan(entries, whole), folder, "scan", "zstd")
    release(spark)
    shown = scan.where("border is null").select(*_CTX, F.struct("lo", "hi").alias("s"))
    # grams at the borders of two ranges or more (two grams a range at most): their windows are counted over all ranges
    split = [r[0] for r in scan.where("border is not null").groupBy("border").count().where("count > 1").select("border").collect()]
    if split:
        grams = F.broadcast(spark.createDataFrame([(g,) for g in split], "gram_ long"))
        offsets = F.sequence(F.greatest(F.lit(0), reach - F.octet_length("after")), F.least(F.lit(reach), F.octet_length("before")))
        torn = entries.join(grams, _on("gram")).where(F.octet_length("after") + F.octet_length("before") >= reach)
        windows = F.transform(offsets, lambda o: F.struct(o.alias("o"), *[F.xxhash64(F.lit(k), "gram", F.substring("before", F.lit(1), o), F.substring("after", F.lit(1), reach - o)).alias(f"w{k}") for k in (0, 1)]))
        rivals = torn.select(*_CTX, "multi", F.explode(windows).alias("w")).select(*_CTX, "multi", "w.*")
        rivals = stored(rivals, folder, "rivals")
        key = F.xxhash64(*_CTX)
        again = rivals.groupBy("w0", "w1").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a != b").select("w0", "w1")
        settled = rivals.where("not multi").join(_named(again, "w0", "w1"), _on("w0", "w1"))
        shown = shown.unionByName(settled.select(*_CTX, F.struct(F.col("o").cast("int").alias("lo"), F.col("o").cast("int").alias("hi")).alias("s")))

    full = F.struct(F.greatest(F.lit(0), F.lit(reach) - F.octet_length("after")).alias("lo"), F.least(F.lit(reach), F.octet_length("before")).alias("hi"))
    multi = entries.where("multi").select(*_CTX, full.alias("s")).where("s.lo <= s.hi")
    cover = multi.unionByName(shown.where(F.col("s").isNotNull())).groupBy(*_CTX).agg(F.collect_set("s").alias("s"))
    cover = stored(cover, folder, "cover")
    for name in ("entries", "scan", "rivals"):
        discard(spark, f"{folder}/{name}")
    release(spark)
    at = places.join(_named(cover, *_CTX), _on(*_CTX)).select("tkey", "second", F.explode("s").alias("s"), "pos")
    run = F.struct((F.col("pos") - F.col("s.hi")).alias("start"), (F.col("pos") - F.col("s.lo") + SPAN).alias("end"))
    return at.select("tkey", "second", run.alias("r")).groupBy("tkey", "second").agg(F.collect_set("r").alias("runs"))


#: Rows whose spans are worked through at once.
ROWS = 200


def _rest(raw: bytes, spans: list[dict]) -> tuple[list[dict], bytes]:
    """The spans with those that meet made one, and the bytes outside them."""
    united: list[dict] = []
    for s in sorted((r["start"], r["end"]) for r in spans):
        if united and s[0] <= united[-1]["end"]:
            united[-1]["end"] = max(united[-1]["end"], s[1])
        else:
            united.append({"start": s[0], "end": s[1]})
    cuts = [0, *(x for r in united for x in (r["start"], r["end"])), len(raw)]
    return united, b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_out: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, runs, kept_sha256, kept) of every row; ``kept`` is binary, absent without ``text_out``."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({"tkey": F.xxhash64("text"), "second": F.xxhash64(F.lit(1), "text")})
    copies = stored(keyed.groupBy("tkey", "second").agg(F.count("*").alias("copies"), F.min("id").alias("rep")), folder, "copies")
    runs = stored(repeated_bytes(keyed, copies, folder), folder, "runs", "zstd")
    for name in ("places", "cover"):
        discard(spark, f"{folder}/{name}")
    release(spark)
    kind = keyed.schema["id"].dataType.simpleString()
    plan = copies.join(_named(runs, "tkey", "second"), _on("tkey", "second"), "left").select(F.col("tkey").alias("tkey_"), F.col("second").alias("second_"), "copies", "runs")
    size = F.octet_length("text")
    gone = (F.col("copies") > 1) & (size >= SPAN)
    spans = F.when(gone, F.array(F.struct(F.lit(0).alias("start"), size.alias("end")))).otherwise(F.col("runs"))
    # the digest of a text that stays whole is taken here; only texts with spans need the worker
    joined = keyed.join(plan.where("copies > 1 or runs is not null"), _on("tkey", "second"), "left").select("id", "text", spans.alias("spans"))
    text = F.col("text") if text_out else F.when(F.col("spans").isNotNull(), F.col("text"))
    source = joined.select("id", size.cast("long").alias("n"), F.when(F.col("spans").isNull(), F.sha2("text", 256)).alias("sha"), "spans", text.cast("binary").alias("text"))
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, runs array<struct<start:int,end:int>>, kept_sha256 string" + (", kept binary" if text_out else "")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), span, pa.string(), *[pa.binary()] * text_out]
    names = [id_col, "n_bytes", "n_removed", "runs", "kept_sha256", *["kept"] * text_out]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                rows = []
                for sha, found, raw in zip(*[part.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                    if found is None:
                        rows.append((0, [], sha, raw))
                        continue
                    united, kept = _rest(raw, found)
                    rows.append((len(raw) - len(kept), united, hashlib.sha256(kept).hexdigest(), kept))
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names)
            give_back()

    return source.mapInArrow(rebuild, schema)

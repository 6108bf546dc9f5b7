"""Op 2: near-duplicate groups by SetSketch registers.

A text's set holds its distinct k-word shingles (64-bit hashes of lower-cased words). Register i of
its sketch is the greatest of floor(1 - log_b(h_i)) over the shingles, h_i being exponential with
rate RATE and values cut to 0..LEVELS + 1: an exponentially spaced truncated minimum. Registers of a
union are the maxima of registers, and they agree more often the more similar two sets are.

1. Texts with equal sets are one class; a class is represented once from here on, so groups of
   copies of any size cost one row.
2. Bands of ROWS registers are hashed; classes that share a band value are candidates. In every
   bucket the least class is the pivot, and each class keeps the pivot of greatest similarity, as
   estimated jointly from both registers by maximum likelihood.
3. Candidates are verified on their full sets, and links give connected components.
4. Classes of a bucket that are not in its main component meet all that share a bucket of that
   component, block against block on their full sets, and components are computed again. A block
   pair gives at most as many links as it has classes, so no bucket is written out as pairs, and no
   pair that shares a band is left out unless it is inside one component already.

A pair at the threshold is missed with probability (1 - 0.75**3)**24, about 2 in a million.

Results for odd inputs: null and empty texts have size 0 and are linked with nothing; fewer than k
words give one shingle; rows with equal texts share a component, also under one id; a null id keeps
its own row, and a component's id is the least id that is not null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import U64, Words, chunks, gram_hashes, mix
from .components import components
from .tables import discard, release, shared_folder, stored, text_keys, unused

SHINGLE = 5
SIMILARITY = (75, 100)
BANDS, ROWS = 24, 3
REGISTERS = BANDS * ROWS
BASE = 1.001
RATE = 20.0
LEVELS = 2**16 - 2
#: A candidate goes on while the likelihood at the threshold is at least exp(-SLACK) of the greatest.
SLACK = 12.0
#: Classes of a block.
BLOCK = 96
#: Blocks of a main component that meet a block of strays in one task.
GROUP = 16

_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xD1B54A32D192ED03))


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by row and hash."""
    hashes = words.hashes()
    grams = gram_hashes(hashes, k)
    whole = np.flatnonzero(words.row[: len(grams)] == words.row[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
    row, value = [words.row[whole]], [grams[whole]]
    counts = np.diff(words.first)
    for size in range(1, k):  # the whole sequence of a short text
        rows = np.flatnonzero(counts == size)
        if len(rows):
            at = words.first[rows]
            value.append(mix(np.stack([gram_hashes(hashes[a : a + size], size)[0] for a in at]) + U64(size)) if size > 1 else mix(hashes[at] + U64(size)))
            row.append(rows)
    rows, values = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def registers(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SetSketch registers (sets x REGISTERS) of the non-empty sets that start at ``begins``."""
    out = np.empty((len(begins), REGISTERS), dtype=np.uint16)
    for i in range(REGISTERS):
        h = (values ^ _SEEDS[i]) * U64(0x9FB21C651E98DF25)
        h ^= h >> U64(35)
        h *= U64(0x9FB21C651E98DF25)
        least = np.minimum.reduceat(h, begins)
        uniform = (least.astype(np.float64) + 1.0) / 2.0**64
        value = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LEVELS + 1)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(greater: np.ndarray, less: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of similarity ``j`` where ``greater`` and ``less`` registers of the first set are above and below the second's; ``u``: the first's share of both sizes."""
    v = 1 - u
    up, down = _p(u - v * j), _p(v - u * j)
    tiny = 1e-12
    return greater * np.log(up + tiny) + less * np.log(down + tiny) + (REGISTERS - greater - less) * np.log(np.maximum(1 - up - down, tiny))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity, whether the threshold or more is tenable) of pairs of registers."""
    greater = (a > b).sum(-1).astype(float)
    less = (a < b).sum(-1).astype(float)
    u = na / (na + nb)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    best, at = np.full(greater.shape, -np.inf), np.zeros(greater.shape)
    for j in np.linspace(0, 1, 41):
        value = np.where(j <= most + 1e-9, log_likelihood(greater, less, u, np.minimum(j, most)), -np.inf)
        at = np.where(value > best, j, at)
        best = np.maximum(best, value)
    edge = log_likelihood(greater, less, u, np.minimum(threshold, most))
    return at, ((at >= threshold) | (edge >= best - SLACK)) & (most >= threshold - 1e-12)


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE) -> DataFrame:
    """(id, h1, h2, n, sig, regs): the text's two keys, then size, signature and registers of its set."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[k.alias(f"h{i}") for i, k in enumerate(text_keys(F.col(text_col)), 1)])
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in chunks(batch.column(1)):
                n = end - first
                row, value = shingles(Words(data, at, lower=True), k)
                counts = np.bincount(row, minlength=n)
                full = np.flatnonzero(counts)
                begins = (np.cumsum(counts) - counts)[full]
                sig = np.zeros((n, 2), dtype=U64)
                regs = np.zeros((n, REGISTERS), dtype=np.uint16)
                if len(full):
                    sig[full, 0] = mix(np.add.reduceat(mix(value ^ U64(0x5851F42D4C957F2D)), begins) + counts[full].astype(U64))
                    sig[full, 1] = mix(np.add.reduceat(mix(value + U64(0x14057B7EF767814F)), begins) ^ counts[full].astype(U64))
                    regs[full] = registers(value, begins)
                binary = lambda x, w: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32)), pa.py_buffer(x)])
                of = [batch.column(i).slice(first, n) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*of, pa.array(counts.astype(np.int64)), binary(sig.astype(">u8"), 16), binary(regs, 2 * REGISTERS)], ["id", "h1", "h2", "n", "sig", "regs"])

    return source.mapInArrow(run, f"id {kind}, h1 long, h2 long, n long, sig binary, regs binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(sig, band): a row for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BANDS, ROWS).astype(U64)
            key = np.broadcast_to(np.arange(BANDS, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15), regs.shape[:2]).copy()
            for i in range(ROWS):
                key = mix(key ^ (regs[:, :, i] + U64(i << 20)))
            sigs = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([sigs, pa.array(key.ravel().view(np.int64))], ["sig", "band"])

    return classes.select("sig", "regs").mapInArrow(run, "sig binary, band long")


def _tenable(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, with their sizes and registers) with the estimate; those ruled out are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                j, ok = estimate(x, y, f["na"].to_numpy(float), f["nb"].to_numpy(float), threshold)
                yield pd.DataFrame({"a": f["a"][ok], "b": f["b"][ok], "j": j[ok]})

    return pairs.mapInPandas(run, "a binary, b binary, j double")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs whose full sets are as similar as asked."""
    num, den = similarity
    joined = pairs.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return joined.select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s")).where(F.col("i") * den >= (F.col("s") - F.col("i")) * num).select("a", "b")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(sig, set) of the wanted classes, from the text of one row of each."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted.select("sig", F.col("doc").alias("d")), F.col("id").eqNullSafe(F.col("d"))).select("sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in chunks(batch.column(1)):
                n = end - first
                row, value = shingles(Words(data, at, lower=True), k)
                counts = np.bincount(row, minlength=n)
                full = np.flatnonzero(counts)
                sums = np.zeros((n, 2), dtype=U64)
                if len(full):
                    begins = (np.cumsum(counts) - counts)[full]
                    sums[full, 0] = mix(np.add.reduceat(mix(value ^ U64(0x5851F42D4C957F2D)), begins) + counts[full].astype(U64))
                    sums[full, 1] = mix(np.add.reduceat(mix(value + U64(0x14057B7EF767814F)), begins) ^ counts[full].astype(U64))
                raw = sums.astype(">u8").tobytes()
                sigs = batch.column(0).slice(first, n).to_pylist()
                right = np.array([sigs[i] == raw[16 * i : 16 * i + 16] for i in range(n)], dtype=bool)  # ids may repeat
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), lists], ["sig", "set"]).filter(pa.array(right))

    return rows.mapInArrow(run, "sig binary, set array<long>")


def _blocked(members: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(main, part, parts, name): the classes of every main component's buckets with their sets, in lists of about BLOCK, dealt by a hash."""
    counts = members.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).withColumnRenamed("main", "k")
    dealt = members.join(counts, F.col("main") == F.col("k")).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts"))).drop("k")
    full = dealt.join(sets.withColumnRenamed("sig", "g"), F.col("sig") == F.col("g"))
    return full.groupBy("main", "part", "parts").agg(F.collect_list(F.struct("sig", "root", "set")).alias(name))


def _block_links(mine: pa.StructArray, theirs: pa.StructArray, similarity: tuple[int, int]) -> list[tuple[bytes, bytes]]:
    """Links between two blocks, as the roots of what they join: at most one less than there are roots."""
    num, den = similarity

    def unpack(rows: pa.StructArray) -> tuple[list, list, np.ndarray, np.ndarray]:
        lists = rows.field("set")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
        return rows.field("sig").to_pylist(), rows.field("root").to_pylist(), sizes, flat

    sig, root, n, x = unpack(mine)
    other, their_root, m, y = unpack(theirs)
    common = np.intersect1d(x, y)
    shared = np.zeros((len(sig), len(other)), dtype=np.float32)
    row_x, row_y = np.repeat(np.arange(len(sig)), n), np.repeat(np.arange(len(other)), m)
    for low in range(0, len(common), 16_384):
        part = common[low : low + 16_384]
        sides = []
        for rows, values, count in ((row_x, x, len(sig)), (row_y, y, len(other))):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            side = np.zeros((count, len(part)), dtype=np.float32)
            side[rows[hit], at[hit]] = 1
            sides.append(side)
        shared += sides[0] @ sides[1].T
    both = np.rint(shared).astype(np.int64)
    linked = den * both >= num * (n[:, None] + m[None, :] - both)
    parent: dict[bytes, bytes] = {}

    def find(v: bytes) -> bytes:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = find(root[i]), find(their_root[j])
        if a != b:
            parent[a] = b
            out.append((root[i], their_root[j]))
    return out


def _cross_links(open_: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between the roots of different components that meet in a bucket, each pair once.

    The classes that aren't in their bucket's main component are compared, on their full sets, with
    all that share a bucket of that component: block against block, by a matrix product.
    """
    everyone = open_.select("main", "sig", "root").distinct()
    strays = everyone.where("root != main")
    dealt = [strays.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).alias("n")), everyone.groupBy("main").agg(F.ceil(F.count("*") / (BLOCK * GROUP)).alias("n"))]
    # each block of strays meets GROUP blocks of its component in one task: the key has both sides' parts
    mine = _blocked(everyone, sets, "mine").join(dealt[0], "main").select("main", F.floor(F.col("part") / GROUP).alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part"), "mine")
    theirs = _blocked(strays, sets, "strays").join(dealt[1], "main").select("main", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("group"), "part", "strays")
    blocks = mine.join(theirs, ["main", "group", "part"]).select("mine", "strays")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _block_links(batch.column(0)[i].values, batch.column(1)[i].values, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return blocks.mapInArrow(run, "a binary, b binary").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: tuple[int, int], k: int) -> tuple[DataFrame, DataFrame, str]:
    """The sketches of all rows, (s, root) of all classes, and the folder of the tables: linked classes have one root."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    threshold = similarity[0] / similarity[1]
    rows = stored(sketches(docs, id_col, text_col, k), folder, "sketches")
    classes = stored(rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("regs").alias("regs")), folder, "classes")

    bands = stored(band_keys(classes), folder, "bands")
    shared = bands.groupBy("band").agg(F.min("sig").alias("pivot"), F.count("*").alias("c")).where("c > 1")
    members = stored(bands.join(shared.select(F.col("band").alias("k"), "pivot"), F.col("band") == F.col("k")).select("band", "sig", "pivot"), folder, "members")
    discard(spark, f"{folder}/bands")

    # each class and its most likely pivot
    side = classes.select("sig", "n", "regs")
    pairs = members.where("sig != pivot").select(F.col("pivot").alias("a"), F.col("sig").alias("b")).distinct()
    pairs = pairs.join(side.toDF("b", "nb", "rb"), "b").join(side.toDF("a", "na", "ra"), "a")
    likely = _tenable(pairs, threshold).groupBy("b").agg(F.max_by("a", F.struct("j", "a")).alias("a")).select("a", "b")
    likely = stored(likely, folder, "likely")

    wanted = members.select("sig").distinct().join(classes.select("sig", "doc"), "sig")
    sets = stored(_full_sets(docs, wanted, id_col, text_col, k).groupBy("sig").agg(F.first("set").alias("set")), folder, "sets")
    release(spark)
    links = stored(_verified(likely, sets, similarity), folder, "links-1")
    roots = stored(components(links, folder), folder, "roots-1")

    # what is not in its bucket's main component meets the rest of the bucket
    placed = stored(members.select("band", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("band", "sig", F.coalesce("root", "sig").alias("root")), folder, "placed")
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("band").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select(F.col("band").alias("k"), F.col("m.root").alias("main"))
    main = stored(main, folder, "main")
    open_ = placed.join(main, F.col("band") == F.col("k")).select("sig", "root", "main")
    links = stored(links.union(_cross_links(open_, sets, similarity)), folder, "links-2")
    roots = stored(components(links, folder), folder, "roots-2")
    named = classes.select("sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(F.col("sig").alias("s"), F.coalesce("root", "sig").alias("root"))
    named = stored(named, folder, "named")
    release(spark)
    for name in ("likely", "links-1", "links-2", "roots-1", "roots-2", "main", "members", "sets", "placed", "classes"):
        discard(spark, f"{folder}/{name}")
    return rows, named, folder


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    rows, named, folder = _classes(docs, id_col, text_col, similarity, k)
    of = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("doc")).join(named, F.col("sig") == F.col("s")).select("s", "root", "doc")
    least = of.groupBy("root").agg(F.min("doc").alias("least")).withColumnRenamed("root", "r")
    of = stored(of.join(least, F.col("root") == F.col("r")).select("s", "least"), folder, "least")
    full = rows.select("id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    out = full.join(of, F.col("sig") == F.col("s"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """One row of each component, with its columns: the one of least id (a null id comes last), on ties of least text key.

    Rows are told apart by id and text, not by id alone: two texts under one id are two rows, and of
    rows that repeat id and text one stays. Texts without words are in no component and all stay.
    """
    rows, named, folder = _classes(docs, id_col, text_col, similarity, k)
    member = rows.where("n > 0").join(named, F.col("sig") == F.col("s")).select("root", "id", "h1", "h2")
    best = member.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h1", "h2")).alias("b")).withColumnRenamed("root", "r")
    first = F.col("id").eqNullSafe(F.col("b.id")) & (F.col("h1") == F.col("b.h1")) & (F.col("h2") == F.col("b.h2"))
    marks = member.join(best, F.col("root") == F.col("r")).groupBy("id", "h1", "h2").agg(F.first(first).alias("best"), F.count("*").alias("c"))
    marks = stored(marks.where("not best or c > 1"), folder, "marks")
    for name in ("sketches", "named"):
        discard(docs.sparkSession, f"{folder}/{name}")
    release(docs.sparkSession)
    name = {n: unused(n, docs.columns) for n in ("id_", "h1_", "h2_", "best_")}
    marks = marks.select(*[F.col(n[:-1]).alias(name[n]) for n in name])
    keys = text_keys(F.col(text_col))
    same = F.col(id_col).eqNullSafe(F.col(name["id_"])) & (keys[0] == F.col(name["h1_"])) & (keys[1] == F.col(name["h2_"]))
    own = [F.col(f"`{c}`") for c in docs.columns]
    lone = docs.join(marks, same, "left_anti")
    if not marks.where(name["best_"]).limit(1).count():
        return lone
    # what repeats id and text of the row that stays: one of them
    again = docs.join(marks.where(name["best_"]), same).groupBy(*[name[n] for n in ("id_", "h1_", "h2_")]).agg(F.first(F.struct(*own)).alias(name["best_"]))
    return lone.unionByName(again.select(f"{name['best_']}.*"))

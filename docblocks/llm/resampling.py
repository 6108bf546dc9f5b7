"""Op 12: importance resampling towards a target distribution, by a dictionary of distinct features.

Features are runs of words. Their strings are counted over the whole corpus; each distinct string is hashed
once, and buckets are sums of the dictionary's counts. A bucket's gain is the log ratio of its smoothed
shares in the target and in the corpus; gains (one a bucket) go back to the dictionary, and from there to the
counts of every document's features. Their sum is the document's weight. Weights with Gumbel noise drawn from
the id alone are scores, and the highest scores are a sample without replacement.

Features that make up one in ``FREQUENT`` of the corpus or more are at most so many: their gains are
broadcast, and a document's counts meet them where it is read. What is left, one row a document and feature with its
count, meets the rest of the dictionary by a shuffle in which no feature is frequent; a feature too long to be
broadcast is dealt to ``SPREAD`` places. Ranks come from a range sort of narrow rows with a tie breaker.

Results for odd inputs: null and empty texts have no features, weight 0; a null id is written as nothing
and comes last of equal scores; rows that repeat an id are rows of their own; texts are handled whole; an empty
corpus gives no rows, an empty target gains of its own smoothing; further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import shared_folder, stored

BUCKETS, SEED, LEAST_WORDS = 10_000, 2024, 20
#: Bytes of words: ASCII letters, lower-cased, digits, and all bytes of other characters; the others are spaces.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))
FREQUENT, LONGEST, SPREAD = 100_000, 256, 64
#: Features and rows that a task holds before it hands them on.
HELD = 200_000


def features(text: bytes | None, order: int = 1) -> tuple[list[bytes], int]:
    """(all runs of 1 to ``order`` consecutive words of a text, how many words), only A-Z lower-cased."""
    words = (text or b"").translate(_PLAIN).split()
    runs = list(words)
    for n in range(2, order + 1):
        runs += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return runs, len(words)


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def _counted(texts: DataFrame, text_col: str, order: int) -> DataFrame:
    """(feature, s) of all texts: batches count their own features first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["feature", "s"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(features(text.as_py(), order)[0])
                if len(seen) >= HELD:
                    yield hand_on()
        if seen:
            yield hand_on()

    rows = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "feature binary, s long")
    return rows.groupBy("feature").agg(F.sum("s").alias("s"))


def gains(dictionary: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """(bucket, gain) of every bucket that the corpus fills, and the corpus's features; both tables are (feature, s)."""
    sums = lambda d, name: d.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.sum("s").alias(name))
    total, target_total = (int(d.agg(F.sum("s")).first()[0] or 0) for d in (dictionary, target))
    joined = sums(dictionary, "s").join(F.broadcast(sums(target, "t")), "bucket", "left")  # a row a bucket at most
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1) * F.lit(float(total + buckets)) / ((s + 1) * F.lit(float(target_total + buckets)))
    return joined.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain")), total


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", order: int = 1, buckets: int = BUCKETS, folder: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(row, id, n_words, n_features, weight) of every row of ``docs``."""
    folder = folder or shared_folder(docs.sparkSession)
    dictionary = stored(_counted(docs, text_col, order), folder, "dictionary")
    gain, total = gains(dictionary, _counted(target, target_text, order), buckets)
    valued = dictionary.withColumn("bucket", bucket(F.col("feature"), buckets)).join(F.broadcast(gain), "bucket").select("feature", "s", "gain")
    valued = stored(valued, folder, "valued")
    is_frequent = (F.col("s") * frequent >= total) & (F.octet_length("feature") <= LONGEST)
    # at most ``frequent`` entries of ``LONGEST`` bytes, whatever the corpus
    known = docs.sparkSession.sparkContext.broadcast({bytes(r[0]): r[1] for r in valued.where(is_frequent).select("feature", "gain").toLocalIterator()})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document with the sum of its frequent features, then one for each of its rare ones."""
        gain_of = known.value
        names = ["row", "id", "rare", "w", "c", "g"]
        for batch in batches:
            at, rare, w, c, g = [], [], [], [], []

            def hand_on(batch=batch, at=at, rare=rare, w=w, c=c, g=g) -> pa.RecordBatch:
                of = pa.array(at, pa.int64())
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(rare, pa.binary()), *(pa.array(x, pa.int64()) for x in (w, c, g))]
                for x in (at, rare, w, c, g):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names)

            for i, text in enumerate(batch.column(2)):
                runs, n_words = features(text.as_py(), order)
                counts = Counter(runs)
                left = [(f, n) for f, n in counts.items() if f not in gain_of]
                unknown = sum(n for _, n in left)
                rare += [None, *(f for f, _ in left)]
                c += [len(runs) - unknown, *(n for _, n in left)]
                w += [n_words, *[0] * len(left)]
                g += [sum(n * gain_of[f] for f, n in counts.items() if f in gain_of), *[0] * len(left)]
                at += [i] * (1 + len(left))
                if len(at) >= HELD:
                    yield hand_on()
            if at:
                yield hand_on()

    counts = stored(rows.mapInArrow(weigh, f"row long, id {id_type}, rare binary, w long, c long, g long"), folder, "counts")
    place = F.when(F.octet_length("rare") > LONGEST, F.pmod(F.xxhash64("row"), F.lit(SPREAD))).otherwise(0).cast("int")
    places = F.when(F.octet_length("feature") > LONGEST, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    rest = valued.where(~is_frequent).select(F.col("feature").alias("f"), "gain", F.explode(places).alias("p"))
    tail = counts.where("rare is not null").withColumn("place", place).join(rest, (F.col("rare") == F.col("f")) & (F.col("place") == F.col("p")))
    parts = tail.select("row", "id", "w", "c", (F.col("c") * F.col("gain")).alias("g")).union(counts.where("rare is null").select("row", "id", "w", "c", "g"))
    return parts.groupBy("row", "id").agg(F.sum("w").alias("n_words"), F.sum("c").alias("n_features"), F.sum("g").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", order: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_features, weight, score, rank): rank 1, 2, ... of the drawn rows by score, null for the others."""
    folder = shared_folder(docs.sparkSession)
    found = weights(docs, target, id_col, text_col, target_text, order, buckets, folder, frequent)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    order_by = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    found = found.withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= least_words)
    ranked = found.repartitionByRange(F.col("able").desc(), *order_by).sortWithinPartitions(F.col("able").desc(), *order_by)
    ranked = stored(ranked.withColumn("at", F.monotonically_increasing_id()), folder, "ranked")

    # places in the whole order: a count for each sorted partition is all that reaches the driver
    part = F.shiftright("at", 33)
    starts, before = [], 0
    able = 0
    for p, n, a in sorted(tuple(r) for r in ranked.groupBy(part.alias("p")).agg(F.count("*"), F.count_if("able")).collect()):
        starts.append((p, before))
        before, able = before + n, able + a
    offsets = F.broadcast(docs.sparkSession.createDataFrame(starts, "p long, before long"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rank = F.when(F.col("able") & (place <= percent * able // 100), place).cast("long")
    return ranked.join(offsets, part == F.col("p")).select(F.col("id").alias(id_col), F.col("n_features").cast("long").alias("n_features"), F.col("weight").cast("long").alias("weight"), "score", rank.alias("rank"))

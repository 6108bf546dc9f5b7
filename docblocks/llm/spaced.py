"""Op 7: benchmark decontamination by spaced-seed hashing, with DataFrame and SQL functions only.

Fixed masks look at some positions of a short run of words and ignore the others, so a substituted
word spoils only the seeds that look at it. Seeds of the benchmark and of the documents are hashed
and joined; a hit fixes a diagonal (where the item would start in the document), and along it the
item's words are compared with the document's: an overlap counts where some ``window`` words of the
item in a row (all of a shorter item) have at least ``share`` of them in place.

``masks_for`` says which masks items of a length need: MASKS, and what else it takes so that every
tolerated pattern of substitutions leaves some mask whole (shorter masks for items of few words). Only
masks that some item needs are hashed in the documents.

Long documents are cut into blocks that overlap by the longest item, so that no row grows with a
text's length; each block sees whole diagonals. What is exploded by position is narrow (block,
position, seed); only the hits meet their block's words again. The benchmark's seeds are broadcast if
there are at most BROADCAST_SEEDS of them, and keys of the texts hit up to BROADCAST_TEXTS; beyond that the same joins are shuffle joins.

Results for odd inputs: null and empty texts and items never match; repeated rows match alike, each
for itself; rows that share an id, or have a null one, are told apart by their texts in
``decontaminate``, and ``overlaps`` gives the best overlap for each id and item; an empty table on
either side gives no rows (no row is dropped); further columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import release, shared_folder, stored, text_keys, unused

#: Masks: 1 looks at a word, 0 ignores it.
MASKS = ("11011", "110011", "101101")
WINDOW = 16
SHARE = 0.75
#: Bounds of the broadcast sides: seeds of items, and keys of texts that one was found in.
BROADCAST_SEEDS, BROADCAST_TEXTS = 200_000, 500_000
BLOCK = 2048


@functools.cache
def masks_for(n: int, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> tuple[str, ...]:
    """The masks that items of ``n`` words need: with them, no tolerated pattern of substitutions in a window goes unseen."""
    n = min(n, window)
    spare = n - math.ceil(n * share)

    def sees(mask: str, wrong: tuple[int, ...]) -> bool:
        return any(not any(mask[w - at] == "1" for w in wrong if 0 <= w - at < len(mask)) for at in range(n - len(mask) + 1))

    base = [m for m in masks if len(m) <= n]
    unseen = [w for k in range(spare + 1) for w in itertools.combinations(range(n), k) if not any(sees(m, w) for m in base)]
    found = list(base)
    # the widest looks first: they hit least by chance
    for weight in range(min(n, 4), 0, -1):
        for width in range(weight, n + 1):
            for inner in itertools.combinations(range(1, width - 1), max(weight - 2, 0)):
                if not unseen:
                    return tuple(found)
                at = {0, width - 1, *inner}
                mask = "".join("1" if i in at else "0" for i in range(width))
                seen = [w for w in unseen if sees(mask, w)]
                if mask.count("1") == weight and seen:
                    found.append(mask)
                    unseen = [w for w in unseen if w not in seen]
    return tuple(found)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(clean) > 0, F.split(clean, " ")).otherwise(F.array().cast("array<string>"))


def _exploded(frame: DataFrame, words: str, masks: dict[str, int], *keep: str) -> DataFrame:
    """A narrow row for each position and mask: kept columns, __pos and __seed; ``masks`` has a number for each."""
    width = max(map(len, masks))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size("__h")
    ahead = F.arrays_zip(*[F.col("__h") if i == 0 else F.slice("__h", i + 1, F.greatest(n, F.lit(1))) for i in range(width)])
    zipped = frame.select(*keep, hashes.alias("__h")).select(*keep, F.posexplode(ahead).alias("__pos", "__w"))
    names = [f.name for f in zipped.schema["__w"].dataType.fields]

    def seed(number: int, mask: str) -> Column:
        looked = [F.col("__w")[names[i]] for i, bit in enumerate(mask) if bit == "1"]
        return F.when(looked[-1].isNotNull(), F.xxhash64(F.lit(number), *looked))

    hashes = zipped.select(*keep, "__pos", F.explode(F.array(*[seed(k, m) for m, k in masks.items()])).alias("__seed"))
    return hashes.where(F.col("__seed").isNotNull())


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(id, item, start, matched, compared): the best overlap of each document with each item that it holds."""
    items = benchmark.select(F.col(item_id).alias("__item"), words_of(F.col(item_text)).alias("__words"))
    lengths = [r[0] for r in items.groupBy(F.size("__words")).count().collect()]  # a row for each length that occurs
    longest = max(lengths, default=0)
    # items by the masks that they need: a mask that only short items need doesn't look at the others
    kinds: dict[tuple[str, ...], list[int]] = {}
    for n in lengths:
        if n:
            kinds.setdefault(masks_for(min(n, window), masks, window, share), []).append(n)
    number = {m: k for k, m in enumerate(dict.fromkeys(m for needed in sorted(kinds, key=len) for m in needed))} or {masks[0]: 0}
    parts = [_exploded(items.where(F.size("__words").isin(of)), "__words", {m: number[m] for m in needed}, "__item") for needed, of in kinds.items()]
    parts = parts or [_exploded(items, "__words", number, "__item")]
    seeds = functools.reduce(DataFrame.unionByName, parts).withColumnRenamed("__pos", "__ipos")
    sides = items.select(F.col("__item").alias("__of"), F.col("__words").alias("__theirs"))
    if seeds.count() <= BROADCAST_SEEDS:
        seeds, sides = F.broadcast(seeds), F.broadcast(sides)

    step = max(BLOCK, 2 * longest)
    key = ["__doc", "__k0", "__k1"]

    def blocked(rows: DataFrame) -> DataFrame:
        """Blocks of (key, text): their own words and the longest item's reach on both sides."""
        begins = F.sequence(F.lit(0), F.greatest(F.size("__all") - 1, F.lit(0)), F.lit(step))
        split = rows.select(*key, words_of(F.col("__text")).alias("__all"))
        # an array of the blocks is exploded, so that no row carries the whole text from here on
        cut = F.transform(begins, lambda b: F.struct(b.alias("from"), F.greatest(b - longest, F.lit(0)).alias("low"), F.slice("__all", F.greatest(b - longest, F.lit(0)) + 1, F.lit(step + 2 * longest)).alias("mine")))
        return split.select(*key, F.explode(cut).alias("__b")).select(*key, F.col("__b.from").alias("__from"), F.col("__b.low").alias("__low"), F.col("__b.mine").alias("__mine"))

    def on(names: list[str]) -> Column:
        return functools.reduce(Column.__and__, [F.col(f"{c}_").eqNullSafe(F.col(c)) for c in names])

    texts = docs.select(F.col(id_col).alias("__doc"), *[k.alias(f"__k{i}") for i, k in enumerate(text_keys(F.col(text_col)))], F.col(text_col).alias("__text"))
    own = F.col("__pos") + F.col("__low") - F.col("__from")
    hits = _exploded(blocked(texts), "__mine", number, *key, "__from", "__low").where(own.between(0, step - 1)).join(seeds, "__seed")
    hits = hits.select(*key, "__from", "__item", (F.col("__pos") - F.col("__ipos")).alias("__start")).distinct().withColumnsRenamed({c: f"{c}_" for c in [*key, "__from"]})
    hits = stored(hits, shared_folder(docs.sparkSession), "hits")  # used twice
    # the texts that were hit, then their blocks that were: few texts are named by 16 bytes each and broadcast
    hit_texts = hits.select("__k0_", "__k1_").distinct()
    if hit_texts.count() <= BROADCAST_TEXTS:
        hit_texts = F.broadcast(hit_texts)
    again = blocked(texts.join(hit_texts, on(["__k0", "__k1"]), "left_semi"))
    met = again.join(hits, on([*key, "__from"])).select("__doc", "__low", "__mine", "__item", "__start").join(sides, F.col("__item").eqNullSafe(F.col("__of")))

    # along the diagonal: 1 where the words agree; the best run of ``window`` words
    agree = "transform(__theirs, (w, i) -> if(__start + i >= 0 and get(__mine, greatest(__start + i, 0)) = w, 1, 0))"
    met = met.withColumn("__agree", F.expr(agree)).withColumn("__span", F.least(F.size("__theirs"), F.lit(window)))
    least = F.ceil(F.col("__span") * share)
    met = met.where(F.aggregate("__agree", F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) >= least)
    best = F.expr("array_max(transform(sequence(0, size(__agree) - __span), s -> aggregate(slice(__agree, s + 1, __span), 0, (a, x) -> a + coalesce(x, 0))))")
    found = met.select("__doc", "__item", (F.col("__start") + F.col("__low")).alias("__start"), best.alias("__matched"), "__span").where(F.col("__matched") >= least)
    one = found.groupBy("__doc", "__item").agg(F.max(F.struct("__matched", (-F.col("__start")).alias("__back"), "__span")).alias("__b"))
    return one.select(F.col("__doc").alias(id_col), F.col("__item").alias(item_id), (-F.col("__b.__back")).cast("int").alias("start"), F.col("__b.__matched").cast("int").alias("matched"), F.col("__b.__span").cast("int").alias("compared"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns; a row is named by its id and its text."""
    key, text = unused("key", docs.columns), unused("held", docs.columns)
    named = F.struct(F.col(id_col).alias("id"), *[k.alias(f"h{i}") for i, k in enumerate(text_keys(F.col(text_col)))])
    rows = docs.select(named.alias(key), F.col(text_col).alias(text))
    spark = docs.sparkSession
    held = stored(overlaps(rows, benchmark, key, text, **params).select(F.col(key).alias(text)).distinct(), shared_folder(spark), "held")
    release(spark)
    return docs.join(held, named.eqNullSafe(F.col(text)), "left_anti")

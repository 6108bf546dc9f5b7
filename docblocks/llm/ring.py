"""Op 4: sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has four cells or more for each virtual node. Every shard owns ``vnodes`` virtual nodes, each at the end of a cell; a
key belongs to the first virtual node at or after its cell. Keys are taken in ring order; one whose
shard is full continues clockwise to the next virtual node of a shard with room. Loads are bounded
by counts: without ``slack``, shard capacities are N // shards, one more for the first N % shards, so
counts differ by one at most and only the overflow leaves its home; with it, a shard takes up to
(1 + slack) times the mean, and one more shard moves little else than its own share (the README has
measured shares).

Only counts of cells (as many as the ring has, by the number of shards) and of sorted partitions reach the driver, which plans
runs of ranks: each run ends an arc or fills a shard, so there are at most vnodes + shards of them.
Rows then find their run by rank. Ranks come from a range sort of narrow rows (no texts) with a tie
breaker, so a key that a third of the rows share is split over partitions like any other.

Results for odd inputs: a null id has a place of its own on the ring; a null text has size 8 and the
checksum of no bytes; repeated rows are separate keys at one place; an empty table gives no rows;
further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shared_folder, stored

#: Least bits of a cell's number; a ring of many shards has more.
BITS = 16
VNODES = 128


def ring_bits(shards: int, vnodes: int = VNODES) -> int:
    """Bits of a cell's number: four cells or more for each virtual node."""
    return max(BITS, (4 * shards * vnodes - 1).bit_length())


def virtual_nodes(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; one that hashes to a taken cell goes to the next free one."""
    cells = 1 << ring_bits(shards, vnodes)
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}:{v}".encode(), digest_size=8).digest(), "big") % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may take: the mean and its share of ``slack``; without slack, counts are at most one apart."""
    if slack:
        return [math.ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan_runs(counts: dict[int, int], shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Runs (first cell, last cell, first rank, shard, first slot) in rank order, from the counts of cells."""
    cells = 1 << ring_bits(shards, vnodes)
    nodes = virtual_nodes(shards, vnodes)
    room = capacities(sum(counts.values()), shards, slack)
    slots = [0] * shards
    runs: list[tuple[int, int, int, int, int]] = []
    # arcs in the order of their keys: the keys beyond the last node belong to the first one
    arcs, begin = [], 0
    for at, (cell, _) in enumerate(nodes):
        arcs.append((begin, cell, at))
        begin = cell + 1
    if begin < cells:
        arcs.append((begin, cells - 1, 0))
    filled = sorted(counts)
    where, rank = 0, 0
    for first, last, home in arcs:
        left = 0
        while where < len(filled) and filled[where] <= last:
            left += counts[filled[where]]
            where += 1
        node = home
        while left:
            shard = nodes[node % len(nodes)][1]
            take = min(left, room[shard])
            if take:
                runs.append((first, last, rank, shard, slots[shard]))
                room[shard] -= take
                slots[shard] += take
                rank += take
                left -= take
            node += 1
    return runs


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """(id, size, text_crc32, shard, slot, home_shard) of every row."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    text = F.col(text_col).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))), 2).alias("__place"),
        F.monotonically_increasing_id().alias("__tie"),
    )
    narrow = stored(narrow, folder, "keys")
    ranked = narrow.repartitionByRange("__place", "__id", "text_crc32", "__tie").sortWithinPartitions("__place", "__id", "text_crc32", "__tie")
    ranked = ranked.withColumns({"__cell": F.shiftright("__place", 62 - ring_bits(shards, vnodes)).cast("int"), "__at": F.monotonically_increasing_id()}).drop("__tie", "__place")
    ranked = stored(ranked, folder, "ranked")
    part = F.shiftright("__at", 33)
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))

    before, offsets = 0, []
    for pid, n in sorted((r[0], r[1]) for r in ranked.groupBy(part.alias("p")).count().collect()):
        offsets.append((pid, before))
        before += n
    counts = {r[0]: r[1] for r in ranked.groupBy("__cell").count().collect()}
    runs = plan_runs(counts, shards, vnodes, slack)
    nodes = virtual_nodes(shards, vnodes)

    spread, home = [], 0
    by_arc: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for first, last, rank, to, slot in runs:
        by_arc.setdefault((first, last), []).append((rank, to, slot))
    for (first, last), parts in by_arc.items():
        while home < len(nodes) and nodes[home][0] < first:
            home += 1
        owner = nodes[home % len(nodes)][1]
        ends = [p[0] for p in parts[1:]] + [None]
        for cell in range(first, last + 1):
            if cell in counts:
                spread += [(cell, rank, end, to, slot, owner) for (rank, to, slot), end in zip(parts, ends, strict=True)]
    #: at most a row for each cell and run, and a row for each sorted partition: bounded whatever the input
    table = F.broadcast(spark.createDataFrame(spread, "__c int, __first long, __end long, shard int, __slot long, home_shard int"))
    starts = F.broadcast(spark.createDataFrame(offsets, "__p long, __before long"))
    rank = F.col("__before") + inside
    rows = ranked.join(starts, part == F.col("__p")).withColumn("__rank", rank)
    rows = rows.join(table, (F.col("__cell") == F.col("__c")) & (F.col("__rank") >= F.col("__first")) & (F.col("__end").isNull() | (F.col("__rank") < F.col("__end"))))
    return rows.select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("__slot") + F.col("__rank") - F.col("__first")).alias("slot"), "home_shard")

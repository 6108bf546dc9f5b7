"""Connected components of an edge table, by rounds of joins.

Every node keeps a parent, the least known node that it reaches. In each round the grandparents of
neighbours hook parents and nodes, and parents jump to grandparents (the FastSV scheme), so the
number of rounds grows with the logarithm of a chain's length. Each round's table is written to the
shared folder; nothing but the count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored


def components(edges: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the least node that it reaches."""
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stored(both.union(both.select("v", "u")).distinct(), folder, "cc-edges")
    first = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("f"))
    state, number = stored(first, folder, "cc-0"), 0
    while True:
        parents = state.select(F.col("node").alias("p"), F.col("f").alias("g"))
        grand = stored(state.join(parents, F.col("f") == F.col("p")).select("node", "f", "g"), folder, f"cc-g{number}")
        near = both.join(grand.select(F.col("node").alias("n"), F.col("g").alias("vg")), F.col("v") == F.col("n")).groupBy("u").agg(F.min("vg").alias("m"))
        hooks = grand.join(near.withColumnRenamed("u", "k"), F.col("node") == F.col("k"))
        offers = hooks.select(F.explode(F.array(F.struct(F.col("f").alias("node"), F.least("m", "g").alias("x")), F.struct("node", F.least("m", "g").alias("x")))).alias("o")).select("o.*")
        best = offers.groupBy("node").agg(F.min("x").alias("x"))
        number += 1
        after = grand.join(best.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("node", F.least("f", F.coalesce("x", "f")).alias("f"), F.col("f").alias("old"))
        after = stored(after, folder, f"cc-{number}")
        changed = after.where("f < old").limit(1).count()
        for old in (f"cc-g{number - 1}", f"cc-{number - 1}"):
            discard(spark, f"{folder}/{old}")
        state = after.select("node", "f")
        if not changed:
            discard(spark, f"{folder}/cc-edges")
            return state.withColumnRenamed("f", "root")

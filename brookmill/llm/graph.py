"""Connected components of a distributed link table, by alternating large-star and small-star steps.

Defined cases: links with a null end and links of a node to itself are ignored; repeated links count once; an empty table
gives no rows. Steps repeat until nothing changes, which takes a number of rounds that is logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm.common import durable, spread_join


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour m and number n of links of each u, combined before the shuffle: a hub is one row for each task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("m", "u"))
    return spread_join(both.where("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Links point from the larger node u to the smaller v."""
    least = _least(links)
    moved = spread_join(links, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where("u != v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node that isn't itself the smallest of its component.

    links: columns u, v of one orderable type, in any order, with repeats. Every step is a join and a minimum that is
    combined before its shuffle; nothing is gathered by node, and a hub's links stay where they are, as its row is broadcast
    (`spread_join`). Each round ends in a checkpoint.
    """
    now = durable(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, total = None, now.count()  # a step never adds links
    while True:
        now = durable(_small_star(_large_star(now, total), total))
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, total = tuple(state), state[0]

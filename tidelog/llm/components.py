"""Connected components of a link table, by alternating star contractions.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Every round is two group-bys without collected neighbour lists, so one vertex
with very many links stays an aggregate. Rounds are cut by tables in the shared
folder; only one counter per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(low, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(low.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links between comparable ids -> (node, component): component is the smallest id.

    Vertices without links don't appear. An empty table gives an empty table.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        before, now = now, materialize(_small_star(_large_star(now)))
        discard(before)
        # A fixpoint is a forest of stars: order-free fingerprint of the edge set.
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        mark = tuple(got)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")

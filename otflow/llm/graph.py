"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every end of an edge (columns u and v, longs); root is the smallest node reachable.

    Each round links every node's larger neighbours to the smallest one, then
    every node and its smaller neighbours to the smallest; it ends when all
    edges point at roots. Nodes of many edges don't hurt: minima are partially
    aggregated and the join back may be split by AQE. Loops and repeated edges
    don't matter; without edges the result is empty.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    pairs = materialize(pairs, "stars")
    seen = None
    while (state := _state(pairs)) != seen:
        seen = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that the joins deal both sides and a hub's edges may be split.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, "large-stars")
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(lower, "u")
        links = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        before, pairs = pairs, materialize(links.distinct(), "stars")
        for spent in (before, least, large, lower):
            discard(spent)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(pairs: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(hashed)).first())

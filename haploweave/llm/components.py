"""Connected components of a graph given as links, by alternating large-star and small-star steps (public: Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (vertex, component): every vertex that has a link to another, with the smallest vertex it can reach.

    Each step keeps the number of links or lowers it, works on all links in parallel and never brings a vertex's
    neighbours into one task: minima are partial aggregates, and the joins back to a hub's links can be split.
    Rounds grow with the logarithm of the diameter. Null ends and self-links are ignored; repeated links count once.
    """
    edges = save(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new = save(small, "small-star")
        discard(large)
        discard(edges)
        edges = new
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())

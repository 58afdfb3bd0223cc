"""Connected components of a graph of any size, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, store

#: Shuffle partitions per file of a table of edges.
CONTROL = 16


def _star_round(star: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Large star: every larger neighbour of u goes to the smallest of u's closed neighbourhood.
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    # Small star: u and its smaller neighbours go to the smallest of them.
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(star: DataFrame) -> bool:
    """Whether each node is a centre or has exactly one: then centres name the components."""
    ends = star.select(F.col("u").alias("n"), F.lit(1).alias("out")).unionByName(star.select(F.col("v").alias("n"), F.lit(0).alias("out")).distinct())
    seen = ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return seen.where("out > 1 or (out = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    edges: (a, b) of one ordered type.  Alternating large-star and small-star rounds, each
    a min-aggregate with map-side combine and an equi-join that adaptive
    execution can split, so a hub is never gathered into one task.  Rounds are
    logarithmic in the length of the longest path and go on until the edges are
    stars, tested exactly; a round's table goes once the next is written.  Null
    endpoints and loops are dropped; no edges give no rows."""
    star = store(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct(),
        "cc-edges",
        files=CONTROL,
    )
    while not _is_stars(star):
        before, star = star, store(_star_round(star), "cc-round", files=CONTROL)
        discard(before)
    own = star.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)

"""Connected components of a link table, by large-star and small-star steps.

Each step is an aggregate (the smallest neighbour, combined before the shuffle) and a join, so a
node with very many links is never gathered in one task. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it can reach.

    ``links``: two columns of one ordered type. Self links and repeated links are allowed; rows
    with a null end are ignored. An empty table gives an empty result.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    pairs = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialize(pairs.distinct(), "links")
    before = None
    while True:
        # large star: each larger neighbour of u goes to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(_least_neighbour(both).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        # small star: each smaller neighbour of u, and u itself, goes to the least of them
        least = materialize(_least_neighbour(large), "least")
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = materialize(small, "small")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

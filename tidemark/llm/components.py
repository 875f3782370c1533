"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stage import freeze


#: Edges in one partition of a frozen state. Star rounds are many and their tables often small.
EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge ``(a, b)``; root is the component's least node.

    Both steps keep connectivity and turn every component into a star around its least node
    in a logarithmic number of rounds. Minima are combined map-side and frozen, so the join
    back to a node with very many edges may be split by adaptive execution. Nothing but the
    edge count and a checksum reaches the driver. Self-loops and repeated edges are allowed.
    """
    current = freeze(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    seen = _state(current)
    parts = 1 + int(seen[0] // EDGES)
    current = freeze(current.coalesce(parts))
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = freeze(
            both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
        )
        large = freeze(
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
            .coalesce(parts)
        )
        least = freeze(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
        current = freeze(
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
            .coalesce(parts)
        )
        now = _state(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

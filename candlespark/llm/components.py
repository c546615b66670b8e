"""Connected components of a link table, as alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import cut

MAX_ROUNDS = 40


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges with ``m`` of their ``u``.

    The hash beside ``u`` keeps the join from taking over the aggregation's partitions: with a
    shuffle of its own on both sides, adaptive execution can split a hub's edges.
    """
    return edges.withColumn("h", F.hash("u")).join(least.withColumn("h", F.hash("u")), ["u", "h"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node reachable.

    Rounds end when the number of edges and the sum of their 64-bit hashes stay. Chains of 60 links
    take 5 rounds; MAX_ROUNDS is for chains beyond any number of rows, so reaching it is an error.

    Each round links every node to the smallest node known around it (large star, then small
    star), so the number of rounds grows with the logarithm of the longest chain. All state is
    in DataFrames, cut to the shared checkpoint folder once a round; nothing but a row count and
    a checksum comes to the driver. Minima are aggregated before the shuffle, and neighbours
    reach their hub through a join that adaptive execution may split, so a hub of any size is
    no single task's work. Self links and null ends are ignored; repeated links count once.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: the larger neighbours of u, and u itself, go to the smallest around u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = _met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u itself, go to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = _met(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        state = (row[0], row[1])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

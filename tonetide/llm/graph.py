"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetide.session import cut_lineage


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step: hang neighbours of each node ``u`` on the least node around it.

    Uses ``min`` and a join, never a list of neighbours: a node with very many of them is
    combined before the shuffle and its rows can be split by adaptive execution.
    """
    if larger:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if larger:
        hung = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.union(least.where("u <> m").select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    Alternating large-star and small-star steps: a logarithmic number of rounds in
    practice, each one a few shuffles of at most as many edges as there were. Each round
    is written to the shared folder, so a lost executor costs no earlier round. An empty
    edge table gives an empty result; loops and repeated edges are harmless.
    """
    pairs = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where("u <> v").distinct()
    pairs = cut_lineage(pairs, "links")
    before = None
    for _ in range(rounds):
        pairs = cut_lineage(_star(_star(pairs, True), False), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.union(roots)

"""Connected components of a distributed graph by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a grouped
minimum with map-side combination and one join by node whose hot side AQE can split; links
never gather at the driver or in one task, and tables between rounds lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _parents(edges: DataFrame) -> DataFrame:
    return materialize(edges.groupBy("a").agg(F.min("b").alias("p")), "star-parents")


def _round(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star; an edge (a, b) has a > b."""
    p = _parents(edges)
    # large-star: what hangs on a node that has a smaller neighbour moves to that neighbour
    moved = edges.join(p.withColumnsRenamed({"a": "b", "p": "q"}), "b", "left").select("a", F.coalesce("q", "b").alias("b"))
    large = materialize(moved.unionByName(p.select("a", F.col("p").alias("b"))).distinct(), "star-large")
    drop_table(p)
    # small-star: a node keeps its smallest neighbour, and its other smaller ones go there too
    p = _parents(large)
    others = large.join(p, "a").filter("b <> p").select(F.col("b").alias("a"), F.col("p").alias("b"))
    small = materialize(others.unionByName(p.select("a", F.col("p").alias("b"))).distinct(), "star-small")
    drop_table(p)
    drop_table(large)
    return small


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of comparable node ids -> (node, root) for every node that is not a root.

    A root is the smallest node of its component; self-links, repeated links and links in
    either direction are allowed, and no links give no rows. Null nodes are ignored.
    """
    edges = links.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = materialize(edges.distinct(), "star-links")
    before = _signature(edges)
    while before[0]:
        after = _round(edges)
        drop_table(edges)
        edges, now = after, _signature(after)
        if now == before:
            break
        before = now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.table_path = edges.table_path  # for drop_table, once the result was used
    return out

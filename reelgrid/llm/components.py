"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.session import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node tells its larger neighbours of the smallest
    one around it, then its smaller ones (large-star, small-star). The number of rounds grows with the
    logarithm of the longest path; a hub's neighbours are combined with min(), never collected.

    Defined cases: null ends are left out; loops make their node a component; repeated edges count once.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    loops = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    e, drop = written(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Now every edge points down; each node's smaller neighbours meet at the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new, drop_new = written(small.where("a <> b").distinct())
        changed = new.exceptAll(e).limit(1).count() or e.exceptAll(new).limit(1).count()
        drop()
        e, drop = new, drop_new
        if not changed:
            break
    else:
        raise RuntimeError("connected_components did not settle; raise most_rounds")
    least = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return loops.join(least, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

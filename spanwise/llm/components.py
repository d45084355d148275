"""Distributed connected components by label propagation with pointer jumping, DataFrame operations only.

Every round is one map-side-combined minimum over the edges, self-joins of the pointers (the jumps)
until they stop moving, and joins of labels and edges with them, written to the shared folder. Each
label that is still live after two rounds has taken in another one, so rounds are about twice the
logarithm of the nodes at most, and jumps in a round the logarithm of the longest descent. Edges inside
one component shrink to nothing as they are contracted to their labels, so later rounds move little.
Nothing is collected but a counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge. Null ends are ignored.

    Contract and star: in each round every label takes the smallest neighbouring label, pointers are
    jumped to their ends, and edges are rewritten to labels; edges inside one label vanish.
    """
    live = written(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null").distinct(),
        "cc-edges",
    )
    nodes = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct()
    labels = written(nodes.select("node", F.col("node").alias("component")), "cc-labels")
    kept, live = live, live.where("a < b")
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("l")).agg(F.min("b").alias("m"))
        # Each label points to the least label around it (itself included); pointers never rise.
        last = parent = written(near.select("l", F.least("l", "m").alias("p")), "cc-parent")
        moving = True
        while moving:
            hop = parent.select(F.col("l").alias("p"), F.col("p").alias("q"))
            jumped = written(parent.join(hop, "p").select("l", F.col("q").alias("p"), (F.col("q") < F.col("p")).alias("moved")), "cc-jump")
            moving = not jumped.where("moved").isEmpty()
            discard(last)
            last, parent = jumped, jumped.drop("moved")
        onto = parent.select(F.col("l").alias("component"), "p")
        before, labels = labels, written(labels.join(onto, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "cc-labels")
        pa, pb = parent.select(F.col("l").alias("a"), F.col("p").alias("pa")), parent.select(F.col("l").alias("b"), F.col("p").alias("pb"))
        moved = live.join(pa, "a").join(pb, "b")
        live = written(
            moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct(), "cc-edges"
        )
        discard(before, last, kept)
        kept = live
    discard(kept)
    return labels

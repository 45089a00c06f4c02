"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on a node key. The minimum of a node's neighbours is
combined on the map side, so a hub costs no more than any other node there; the join back on the hub
is a plain sort-merge join, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def _star(edges: DataFrame, both: bool) -> DataFrame:
    forward = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if both:
        forward = forward.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        kept = F.col("v") > F.col("u")
    else:  # src is the larger end already
        kept = F.lit(True)
    least = forward.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = forward.filter(kept).join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    if not both:
        moved = moved.unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    return moved.filter("src <> dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node that has an edge; a component is named by its least node.

    Loops, repeated edges and nulls are ignored. Lineage is cut every round by a checkpoint in the shared folder.
    """
    a, b = F.col(src), F.col(dst)
    edges = edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
    edges = cut(edges.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct())
    state = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
        if state == tuple(mark):
            break
        state = tuple(mark)
        if not state[0]:
            break
        edges = cut(_star(_star(edges, both=True), both=False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component")).distinct()

"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlab.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (least node reachable) for every node of the links ``a, b``.

    Large-star steps hang a node's larger neighbours under its least neighbour, small-star steps
    its smaller ones; both aggregate per node and join back, so a node of any degree is split by
    adaptive execution. The steps stop when the edges are the stars of the components. Loops and
    null ends are left out.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = checkpointed(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = lowest.select("u", F.col("m").alias("v")).unionByName(hung).distinct()
        edges = checkpointed(small)
        # decimal sums of hashes tell edge sets apart without collecting them
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)

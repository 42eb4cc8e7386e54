"""Connected components of an edge table, by alternating star contractions in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionsift.llm.common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b; longs) with the smallest node of its component.

    Each round links every node to the smallest node of its neighbourhood (large star, then small star);
    the rows of a node are only ever aggregated (min), so a node with very many neighbours does not land in
    one task, and the number of rounds grows with the logarithm of the longest chain.  Rounds end when no
    row changes; every round is written to the shared folder.  Self links and null ends are ignored.
    """
    pairs = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "components")
    while True:
        both = pairs.union(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "near")
        least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("m"))
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        large = both.where("near > node").join(least, "node").select(F.col("near").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: smaller neighbours and the node itself are linked to the smallest
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(floor.select("hi", F.col("m").alias("lo")))
        after = staged(small.where("hi <> lo").distinct(), "components")
        # both have distinct rows: equal counts and nothing new means equal tables
        if after.count() == pairs.count() and after.join(pairs, ["hi", "lo"], "left_anti").isEmpty():
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        pairs = after

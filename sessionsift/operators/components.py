"""Connected components of an edge table, in rounds whose number grows with the logarithm of the longest path.

Every node points at a parent with a smaller number.  In each round a node looks at the grandparents of its
neighbours and takes the least of them for itself and for its parent, and skips a step on its own way up; all
three are one minimum per node, aggregated before the shuffle, so that a node with very many neighbours does
not fill a task.  Rounds end when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionsift.session import materialize


def component_labels(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """``(keys..., node, label)``: every node of ``edges(keys..., a, b)`` with the least node of its component."""
    both = edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("near")).union(edges.select(*keys, F.col(b), F.col(a)))
    both = materialize(both)
    parents = materialize(both.groupBy(*keys, "node").agg(F.least(F.min("near"), F.col("node")).alias("parent")))
    while True:
        up = parents.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("grand"))
        grand = parents.join(up, [*keys, "parent"])
        seen = both.join(grand.select(*keys, F.col("node").alias("near"), "grand"), [*keys, "near"])
        seen = seen.groupBy(*keys, "node").agg(F.min("grand").alias("least")).join(grand, [*keys, "node"])
        seen = seen.withColumn("least", F.least("least", "grand"))
        offers = seen.select(*keys, "node", F.col("least").alias("parent")).union(seen.select(*keys, "parent", "least"))
        after = materialize(offers.groupBy(*keys, "node").agg(F.min("parent").alias("parent")))
        changed = after.join(parents.withColumnRenamed("parent", "before"), [*keys, "node"]).where("parent <> before")
        parents = after
        if changed.isEmpty():
            return parents.withColumnRenamed("parent", "label")

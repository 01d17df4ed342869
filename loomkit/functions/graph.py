"""Connected components of an edge table, as joins and aggregates.

Large-star / small-star: every round hangs the larger neighbours of each node,
then the smaller ones, on the smallest.  Only (edge, minimum) rows are joined;
no neighbourhood is gathered, and a few rounds (logarithmic in practice) leave
every node on the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node with an edge to another one;
    ``component`` is the smallest node reachable."""
    e = cut_lineage(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                    .where("hi <> lo").distinct())
    while True:
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min(F.least("hi", "lo")).alias("m"))
        large = both.join(least, "hi").where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"),
                                                                               F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(down, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo") \
            .unionByName(down.select("hi", F.col("m").alias("lo"))).distinct()
        after = cut_lineage(small)
        if after.join(e, ["hi", "lo"], "left_anti").limit(1).count() == 0 \
                and e.join(after, ["hi", "lo"], "left_anti").limit(1).count() == 0:
            break
        e = after
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)

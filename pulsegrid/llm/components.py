"""Connected components of a graph given by edges, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, root``: every vertex with an edge, and the smallest vertex it is connected with.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains shorten by half
    or more; rounds go on until no label changes. Labels are stored after each round, which cuts the lineage. Vertices with very many edges
    meet partial minima on the map side and joins that adaptive execution splits. Loops and repeated edges do no harm.
    """
    once = stored(edges.select(F.col(a).alias("v"), F.col(b).alias("u")).distinct(), "edges")  # the union reads it twice
    both = once.unionByName(once.select(F.col("u").alias("v"), F.col("v").alias("u")))
    labels = stored(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("root").alias("r")), "u").groupBy("v").agg(F.min("r").alias("r"))
        lower = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jumped = lower.join(labels.select(F.col("v").alias("root"), F.col("root").alias("far")), "root").select(
            "v", "old", F.least("root", "far").alias("root"))
        after = stored(jumped, "labels")
        if after.filter("root <> old").isEmpty():
            return after.select("v", "root")
        labels = after.select("v", "root")

"""Connected components as an iteration over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm.staging import dropped, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): component is the smallest id reachable.

    Each round hooks every id, and its parent, to the smallest parent among its
    neighbours, then lets every id jump to its parent's parent. Parents only get
    smaller, so a round that leaves their sum alone is the last. The rounds grow
    with the logarithm of the longest path. Nothing is brought to the driver
    but that sum.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    both = staged(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "links")
    parents = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("parent")), "parents")
    total = F.sum(F.col("parent").cast("decimal(38,0)"))
    before = parents.agg(total).first()[0]
    while before is not None:
        low = both.join(parents.select(F.col("id").alias("b"), F.col("parent").alias("other")), "b").groupBy("a").agg(F.min("other").alias("low"))
        near = parents.join(low.withColumnRenamed("a", "id"), "id").withColumn("low", F.least("parent", "low"))
        hooks = near.select("id", "low").union(near.where(F.col("low") < F.col("parent")).select(F.col("parent").alias("id"), "low"))
        hooked = hooks.groupBy("id").agg(F.min("low").alias("parent"))
        above = hooked.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        later = staged(hooked.join(above, "parent").select("id", F.col("grand").alias("parent")), "parents")
        after = later.agg(total).first()[0]
        dropped(parents)
        parents = later
        if after == before:
            break
        before = after
    dropped(both)
    return parents.select("id", F.col("parent").alias("component"))

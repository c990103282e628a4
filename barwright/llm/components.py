"""Connected components by large-star and small-star steps: joins and minima, no graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barwright.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), ids of any kind of integer; the root is the least node of its component.

    Each step is an aggregate and a join on a node; the minima are pre-aggregated, so a node with very many neighbours costs one row
    per task. Steps repeat until the edges stand still, a number of times that grows with the logarithm of the longest chain.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    stars = materialize(edges.where("a <> b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct())
    before = mark(stars)
    while before[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A local minimum keeps its own neighbours; the others hand their larger neighbours to the least one.
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        stars = materialize(small)
        after = mark(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Joins the neighbours of each node to the least of them: those above it (large), or those below it and itself."""
    if large:
        pairs = pairs.union(pairs.select("b", "a"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges a, b (long, no nulls) -> node, root: the smallest node reachable, for each node with an edge.

    Each round is written to the shared folder; rounds grow with the logarithm of the
    longest chain. A node's neighbours are only ever reduced to their minimum, so a hub is
    pre-aggregated before its rows are moved.
    """
    high_low = lambda df: df.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = None
    state = stored(high_low(edges).distinct())
    while True:
        state = stored(_star(_star(state, True), False))
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b"), F.col("b")).distinct())

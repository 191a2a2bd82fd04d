"""Connected components of edge lists, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import stored


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node itself, go to the smallest of them. Edges are (a, b) with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select(
        "e.*"
    ).filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b, both long and not null) that isn't the smallest of its component.

    The rounds shorten all paths, so their number grows with the logarithm of the longest one; each is written to
    the shared folder, and the last changes nothing.
    """
    oriented = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = stored(oriented, "edges"), None
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new

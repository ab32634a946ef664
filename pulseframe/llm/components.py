"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.session import materialize


def _largest_first(edges: DataFrame) -> DataFrame:
    """Large star: neighbours above a node hang on the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _smallest_first(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours hang on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
            .filter(F.col("a") != F.col("b")).distinct())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node of an edge table (longs ``a``, ``b``).

    Both steps keep the components and end in stars, after a number of rounds that grows with the logarithm of the
    longest path. A node with many neighbours is split by Spark like any skewed join key. Every round is written to
    the shared scratch folder.
    """
    now = materialize(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), label)
    state = None
    while True:
        now = materialize(_smallest_first(_largest_first(now)), label)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            break
        state = tuple(mark)
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))

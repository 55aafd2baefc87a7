"""Connected components by alternating large and small stars; no links leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import Tables


def split_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows joined with few, which was aggregated by key.

    By another key than the aggregation's, so both sides are shuffled for the join alone, and adaptive
    execution can split the rows of a hot key.
    """
    other = F.col(key).bitwiseXOR(F.lit(0x5BD1E995))
    return rows.withColumn("__j", other).join(few.withColumn("__j", other).drop(key), "__j").drop("__j")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. edges: (a, b) with a > b, each once."""
    if large:
        sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        hung = split_join(sides, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = split_join(edges, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) of every node that occurs in links (a long, b long); root is the component's least node.

    Nulls and loops are left out; repeated links count once; no links give no rows. Each round
    halves the depth at least, so the rounds grow with the logarithm of the longest path. A node
    with very many links is a skewed join key, which adaptive execution splits (see split_join).
    """
    a, b = F.col("a"), F.col("b")
    edges = tables.cut(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = None
    while True:
        after = tables.cut(_stars(_stars(edges, True), False))
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        tables.drop(edges)
        edges, state = after, tuple(now)
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

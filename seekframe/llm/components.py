"""Connected components by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekframe.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), component being the least node reachable.

    Edges with a null end and loops add nothing. No edges: no rows. Each round makes every
    node point at the least node it knows of, first from its larger neighbours, then from
    itself; the number of edges never grows, and rounds are logarithmic in practice.
    """
    pairs = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        kept = scratch.keep(large)
        least = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(pairs, kept)
        pairs = after
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(pairs: DataFrame) -> bool:
    """Whether every node points at one node, and none at a node that points on."""
    tails = pairs.select(F.col("u").alias("n"), F.lit(1).alias("t"), F.lit(0).alias("h"))
    heads = pairs.select("v").distinct().select(F.col("v").alias("n"), F.lit(0).alias("t"), F.lit(1).alias("h"))
    nodes = tails.unionByName(heads).groupBy("n").agg(F.sum("t").alias("t"), F.max("h").alias("h"))
    return nodes.where("t > 1 or (t = 1 and h = 1)").isEmpty()

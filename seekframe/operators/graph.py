"""The import graph: who owns what is imported, neighbours, and scores that spread over two hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.kept import keep

FIRST_HOP, SECOND_HOP = 0.65, 0.35
EDGES_MOST = 2000  # of a hop


def prefixes(refs: DataFrame, ref: str = "target") -> DataFrame:
    """``refs`` exploded into each dotted prefix of ``ref``: (..., prefix, depth), so that prefix lookups are equi-joins."""
    depth = F.size(F.split(F.col(ref), r"\."))
    return refs.withColumn("depth", F.explode(F.sequence(F.lit(1), depth))).withColumn("prefix", F.expr(f"substring_index({ref}, '.', depth)"))


def longest_owner(refs: DataFrame, owners: DataFrame, keys: list[str], ref: str = "target") -> DataFrame:
    """(*keys, owner): the owner of the longest dotted prefix of ``ref`` that has one. ``owners``: (qualified, owner)."""
    found = prefixes(refs, ref).join(owners, F.col("prefix") == F.col("qualified"))
    return found.groupBy(*keys).agg(F.max_by("owner", "depth").alias("owner"))


def neighbours(edges: DataFrame, seeds: list[str], budget: int) -> DataFrame:
    """(seed, neighbour): edges at the seeds, outgoing ones first, at most ``budget`` of them."""
    out = edges.where(F.col("src").isin(*seeds)).select(F.lit(0).alias("way"), F.col("src").alias("seed"), F.col("dst").alias("neighbour"))
    into = edges.where(F.col("dst").isin(*seeds)).select(F.lit(1).alias("way"), F.col("dst").alias("seed"), F.col("src").alias("neighbour"))
    return out.unionByName(into).distinct().orderBy("way", "seed", "neighbour").limit(budget).select("seed", "neighbour").distinct()


def hop(rows: DataFrame, edges: DataFrame, keys: tuple[str, ...], budget: int) -> DataFrame:
    """(*keys, seed, path, score): each key's edges at its rows (*keys, path, score), outgoing ones first, at most ``budget``.

    Only edges at the rows are shuffled; the budget is a literal, so that each task cuts its own first.
    """
    at = lambda way, here, there: rows.join(edges.select("src", "dst").withColumnsRenamed({here: "seed", there: "next"}), F.col("path") == F.col("seed")).select(*keys, F.lit(way).alias("way"), "seed", "next", "score")
    both = at(0, "src", "dst").unionByName(at(1, "dst", "src")).where("seed <> next")
    each = both.groupBy(*keys, "seed", "next").agg(F.min("way").alias("way"), F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("way", "seed", "next"))
    return each.withColumn("n", place).where(F.col("n") <= budget).select(*keys, "seed", F.col("next").alias("path"), "score")


def spread(seeds: DataFrame, edges: DataFrame, known: DataFrame, keys: tuple[str, ...] = (), budget: int = EDGES_MOST) -> DataFrame:
    """(*keys, path, graph): scores of what lies one and two hops from each key's seeds, of known paths.

    ``seeds``: (*keys, path, score), ``edges``: directed, repeats allowed. A second hop may lead back to a seed, not to where
    it starts. Each hop of a key takes ``budget`` edges.
    """
    best = seeds.where("score > 0").groupBy(*keys, "path").agg(F.max("score").alias("score"))
    first = hop(best, edges, keys, budget).groupBy(*keys, "path").agg(F.max("score").alias("score"))
    first = keep(first, "first-hop")
    second = hop(first, edges, keys, budget).select(*keys, "path", (F.col("score") * SECOND_HOP).alias("graph"))
    reached = first.select(*keys, "path", (F.col("score") * FIRST_HOP).alias("graph")).unionByName(second)
    scored = reached.groupBy(*keys, "path").agg(F.least(F.lit(1.0), F.max("graph")).alias("graph"))
    return scored.join(known.select("path").distinct(), "path", "left_semi")


def closure(edges: DataFrame, roots: list[str], depth: int = 5) -> DataFrame:
    """(root, node, depth): what references reach within ``depth`` steps, each at its least depth.

    Level by level; what has been reached isn't followed again, so cycles and many paths cost nothing.
    """
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(r, r) for r in dict.fromkeys(roots)], "root string, node string")
    reached = keep(frontier.withColumn("depth", F.lit(0)), "closure")
    for level in range(1, depth + 1):
        after = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = keep(after.join(reached.select("root", "node"), ["root", "node"], "left_anti"), "closure")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(level)))
    return reached.where("depth > 0")

"""Search quality: precision, recall, hit and reciprocal rank at k; latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.kept import keep


def at_k(ranked: DataFrame, relevant: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*keys, precision, recall, hit, reciprocal_rank) of ranked paths against relevant ones.

    ``ranked``: (*keys, path, rank), ``relevant``: (*keys, path). Repeats count once; without relevant paths recall is 1.
    """
    top = ranked.where(F.col("rank") <= k).groupBy(*keys, "path").agg(F.min("rank").alias("rank"))
    known = relevant.select(*keys, "path").distinct().withColumn("good", F.lit(1))
    found = top.join(known, [*keys, "path"], "left").groupBy(*keys).agg(F.count("good").alias("hits"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"))
    total = known.groupBy(*keys).agg(F.count("*").alias("total"))
    both = found.join(total, list(keys), "full_outer").fillna(0, ["hits", "total"])
    return both.select(
        *keys,
        (F.col("hits") / k).alias("precision"),
        F.when(F.col("total") == 0, 1.0).otherwise(F.col("hits") / F.greatest("total", F.lit(1))).alias("recall"),
        F.when(F.col("hits") > 0, 1).otherwise(0).alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def percentiles(rows: DataFrame, value: str, keys: tuple[str, ...], points: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(*keys, p50, p95, ...): exact, between the two nearest values where a point lies between them. Null values don't count.

    Equal values become one row with their number; rows are put into ranges of values, so that a key with any share of all
    rows is spread. A value's place is its place in its range and the numbers of the ranges before.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    ranged = keep(counted.repartitionByRange(*[F.col(c) for c in ("x", *keys)]).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    by_part = W.partitionBy(*keys).orderBy("part")  # a row for each range
    sums = sums.select(*keys, "part", (F.sum("n").over(by_part) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy(*keys)).alias("total"))
    after = F.sum("n").over(W.partitionBy(*keys, "part").orderBy("x"))
    placed = ranged.withColumn("after", after).join(sums, [*keys, "part"]).withColumn("upto", F.col("before") + F.col("after")).withColumn("start", F.col("upto") - F.col("n"))
    at = {p: (F.col("total") - 1) * F.lit(p) / 100 for p in points}
    holds = lambda place: (F.col("start") <= place) & (place < F.col("upto"))
    near = lambda place: F.max(F.when(holds(place), F.col("x")))
    found = placed.groupBy(*keys).agg(*[c for p, a in at.items() for c in (near(F.floor(a)).alias(f"lo{p}"), near(F.ceil(a)).alias(f"hi{p}"), F.max(a - F.floor(a)).alias(f"f{p}"))])
    return found.select(*keys, *[(F.col(f"lo{p}") + (F.col(f"hi{p}") - F.col(f"lo{p}")) * F.col(f"f{p}")).alias(f"p{p}") for p in points])

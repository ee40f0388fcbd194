"""Candidates: merging, explained weighted ranking, reciprocal rank fusion, federation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.functions.text import clamp01

SIGNALS = ("lexical", "exact", "fuzzy", "path_signal", "graph", "recency", "semantic")
# Ranking weights and the order of types.
WEIGHTS = {"lexical": 0.40, "exact": 0.30, "fuzzy": 0.10, "path_signal": 0.10, "graph": 0.10, "recency": 0.05, "semantic": 0.15}
TYPES = ("SYMBOL", "TEST", "FILE", "DOCUMENTATION", "INSTRUCTION", "SKILL", "GIT")
FUSION = 60
MISSING_RANK = 2147483647


def type_place(kind: Column) -> Column:
    place = F.lit(len(TYPES))
    for n, name in reversed(list(enumerate(TYPES))):
        place = F.when(kind == name, n).otherwise(place)
    return place


def with_signals(rows: DataFrame) -> DataFrame:
    """``rows`` with every signal column, 0 where they had none."""
    for s in SIGNALS:
        rows = rows.withColumn(s, F.coalesce(F.col(s), F.lit(0.0)) if s in rows.columns else F.lit(0.0))
    return rows


def merge(rows: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One row per candidate id: the most of each signal, the best type, the first symbol and non-blank excerpt that there is.

    ``rows``: (*keys, id, type, path, symbol, arrival, signals); ``arrival`` orders what "first" means.
    """
    full = with_signals(rows)
    return full.groupBy(*keys, "id").agg(
        F.min_by("type", type_place(F.col("type"))).alias("type"),
        F.min_by("path", "arrival").alias("path"),
        F.min_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("arrival"))).alias("symbol"),
        *([F.min_by("excerpt", F.when(F.trim("excerpt") != "", F.col("arrival"))).alias("excerpt")] if "excerpt" in rows.columns else []),
        *[F.max(s).alias(s) for s in SIGNALS],
    )


def contributions(weights: dict[str, float] = WEIGHTS) -> dict[str, Column]:
    return {s: w * clamp01(F.col(s)) for s, w in weights.items()}


def ranked(rows: DataFrame, limit: int, keys: tuple[str, ...] = ("query_id",), weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``rows`` with score, explanation and rank: weighted sums above 0, best first, at most ``limit`` per key.

    ``explanation`` lists what each signal above 0 adds.
    """
    if not 0 <= weights.get("recency", 0) <= 0.2:
        raise ValueError("the recency weight lies between 0 and 0.2")
    parts = contributions(weights)
    score = sum(parts.values(), F.lit(0.0))
    told = F.array(*[F.when(p > 0, F.concat(F.lit(f"{s}="), F.format_string("%.4f", F.round(p, 4)))) for s, p in parts.items()])
    scored = rows.withColumn("score", score).withColumn("explanation", F.array_join(F.array_compact(told), " ")).where(F.col("score") > 0)
    order = W.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), type_place(F.col("type")), "path", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fused(rows: DataFrame, limit: int, weight: float = 8.0, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*keys, id, path, baseline_rank, semantic_rank, score, rank) by reciprocal ranks.

    ``rows``: (*keys, id, path, type, signals). Without any semantic signal the baseline's order stands.
    """
    if not 0 < weight <= 10:
        raise ValueError("the fusion weight lies above 0 and up to 10")
    base = sum((p for s, p in contributions().items() if s != "semantic"), F.lit(0.0))
    window = W.partitionBy(*keys)
    row = rows.withColumn("base", base).withColumn("near", clamp01(F.col("semantic")))
    by = lambda c: window.orderBy(F.desc(F.round(c, 9)), type_place(F.col("type")), "path", "id")
    # rows without a signal come last, so ranks of those with one are their own
    row = row.withColumn("baseline_rank", F.when(F.col("base") > 0, F.row_number().over(by("base"))))
    row = row.withColumn("semantic_rank", F.when(F.col("near") > 0, F.row_number().over(by("near"))))
    part = lambda r, w: F.when(F.col(r).isNotNull(), w / (FUSION + F.col(r))).otherwise(0.0)
    both = (part("baseline_rank", 1.0) + part("semantic_rank", weight)) / ((1 + weight) / (FUSION + 1))
    row = row.withColumn("score", F.when(F.max("near").over(window) > 0, both).otherwise(F.col("base"))).where("score > 0")
    missing = lambda r: F.coalesce(F.col(r), F.lit(MISSING_RANK))
    order = window.orderBy(F.desc(F.round("score", 9)), missing("baseline_rank"), missing("semantic_rank"), "path", "id")
    return row.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(*keys, "id", "path", "baseline_rank", "semantic_rank", "score", "rank")


def federated(rows: DataFrame, limit: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The best result of each project and path, then the best ``limit`` of all projects.

    ``rows``: (*keys, project, project_place, rank, path, score) from each project.
    """
    best = F.row_number().over(W.partitionBy(*keys, "project", "path").orderBy("rank"))
    order = W.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "project_place", "rank")
    return rows.withColumn("n", best).where("n = 1").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("n")

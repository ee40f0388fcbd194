"""Vector search by cosine, exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIMENSIONS_MOST = 1024
QUERIES_MOST = 2_000


def valid(v: Column) -> Column:
    """Whether a vector has 1 to 1024 finite components, not all 0."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(v).between(1, DIMENSIONS_MOST) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): the closest vectors to each of a few queries, scored (1 + cosine) / 2 and above 0.

    ``vectors``: (id, v), ``queries``: (query_id, q); vectors of another length don't compare. Up to ``QUERIES_MOST`` queries go
    to every task, a few megabytes; more are searched in as many blocks, one after another in the plan.
    """
    blocks = -(-queries.count() // QUERIES_MOST)
    if blocks > 1:
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        parts = [_nearest(vectors, dealt.where(F.col("block") == n).drop("block"), limit) for n in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    return _nearest(vectors, queries, limit)


def _nearest(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    norm = lambda v: F.sqrt(dot(v, v))
    left = vectors.where(valid(F.col("v"))).select("id", "v", norm(F.col("v")).alias("vn"), F.size("v").alias("dims"))
    right = queries.where(valid(F.col("q"))).select("query_id", "q", norm(F.col("q")).alias("qn"), F.size("q").alias("dims"))
    cosine = dot(F.col("v"), F.col("q")) / (F.col("vn") * F.col("qn"))
    both = left.join(F.broadcast(right), "dims").select("query_id", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + cosine) / 2)).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return both.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: What must agree before stored vectors are searched.
PROVENANCE = ("fingerprint", "provider", "model", "dimensions", "profile", "version")


def provenance(told: dict) -> dict[str, str]:
    """The fields of PROVENANCE as text; an error if one is missing or blank, or a number isn't above 0."""
    out = {k: str(told.get(k) or "").strip() for k in PROVENANCE}
    if not all(out.values()) or not all(out[k].isdigit() and int(out[k]) > 0 for k in ("dimensions", "version")):
        raise ValueError(f"provenance needs {', '.join(PROVENANCE)}")
    return out


def embedding_text(files: DataFrame, symbols: DataFrame, most: int = 12_000) -> DataFrame:
    """``files`` with ``text``, what is embedded of each: path, language, its symbols' names and its content's beginning."""
    names = symbols.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("names"))
    both = files.join(names, "path", "left")
    return both.withColumn("text", F.concat_ws("\n", "path", "language", F.coalesce("names", F.lit("")), F.substring("content", 1, most))).drop("names")


def batches(rows: DataFrame, size: int = 32) -> DataFrame:
    """``rows`` (path, ...) with ``batch``: at most ``size`` rows each, dealt by path, so that no list of all paths is put in order."""
    place = F.row_number().over(W.partitionBy("deal").orderBy("path")) - 1
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("path"), F.lit(4096)))
    return dealt.withColumn("batch", F.concat_ws("-", "deal", F.floor(place / size).cast("string"))).drop("deal")

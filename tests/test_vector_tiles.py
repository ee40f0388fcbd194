"""Vectors compared by tiles: the same rows as pair by pair, and no task hands on more than each query's best."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe.operators import semantic, vector_index


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def copies(spark, ids: str):
    """A third are copies of one vector, so that most places are told by ids."""
    r = np.random.default_rng(8)
    one = r.normal(size=8).tolist()
    vectors = [((i * 37) % 1201, one if i % 3 == 0 else (r.integers(-2, 3, size=8) / 2).tolist()) for i in range(1201)]
    known = spark.createDataFrame(vectors, "id int, v array<double>").select(F.col("id").cast(ids).alias("id"), "v")
    asked = [(0, one), (1, [-x for x in one])] + [(i, r.integers(-2, 3, size=8).astype(float).tolist()) for i in range(2, 12)]
    return known, spark.createDataFrame(asked, "query_id int, q array<double>")


@pytest.mark.parametrize("ids", ["int", "string"])
@pytest.mark.parametrize("first", [0, 500, 50_000])
def test_same_as_pair_by_pair(spark, monkeypatch, ids, first):
    for name, value in {"FIRST": first, "TILE": 64, "PAIRS": 50}.items():
        monkeypatch.setattr(vector_index, name, value)
    known, asked = copies(spark, ids)
    middles = vector_index.centroids(known)
    held = vector_index.assigned(known, middles)
    whole = rows(semantic.nearest(known, asked, 6))
    assert rows(vector_index.nearest(held, middles, asked, 6)) == whole
    monkeypatch.setattr(semantic, "QUERIES_MOST", 4)
    assert rows(vector_index.nearest(held, middles, asked, 6)) == whole


def test_tasks_hand_on_the_best_only(spark, monkeypatch):
    known, asked = copies(spark, "int")
    middles = vector_index.centroids(known)
    best, seen = vector_index._best, []
    monkeypatch.setattr(vector_index, "_best", lambda df, limit: seen.append(df) or best(df, limit))
    vector_index.nearest(vector_index.assigned(known, middles), middles, asked, 6)
    tasks = spark.sparkContext.defaultParallelism
    assert 0 < seen[0].count() <= 6 * 12 * tasks < 1201 * 12 / 2


def test_rounded_as_spark_does(spark):
    r = np.random.default_rng(2)
    some = np.concatenate([r.random(2000), np.arange(1, 400) / 400 + 5e-10, (2 * np.arange(300) + 1) / 2**31, [0.5000000005, 0.1234567885, 1.0, 1e-12]])
    told = spark.createDataFrame([(float(x),) for x in some], "x double").select("x", F.round("x", 9).alias("r")).collect()
    assert vector_index.digits(np.array([t["x"] for t in told])).tolist() == [round(t["r"] * 1e9) for t in told]

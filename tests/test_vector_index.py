"""Search over lists against all vectors compared, and how many lists it leaves unread."""

import numpy as np
import pytest

from seekframe.operators import semantic, vector_index

VECTORS, ASKED = "id int, v array<double>", "query_id int, q array<double>"


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(autouse=True)
def looks_twice(monkeypatch):
    monkeypatch.setattr(vector_index, "FIRST", 0)


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    middles = r.normal(size=(25, 16))
    vectors = [(i, (middles[i % 25] + 0.05 * r.normal(size=16)).tolist()) for i in range(2500)]
    vectors += [(3000 + i, vectors[i % 3][1]) for i in range(30)] + [(4000, [0.0] * 16), (4001, None), (4002, [1.0, 2.0]), (4003, [float("nan")] * 16), (4004, [2.0, 4.0])]
    asked = [(i, (middles[i] + 0.05 * r.normal(size=16)).tolist()) for i in range(8)] + [(20, [1.0, 0.0]), (21, [0.0] * 16), (22, None), (23, [1.0, 1.0, 1.0])]
    return spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(asked, ASKED)


def test_exact_and_pruned(spark, clustered, monkeypatch):
    vectors, asked = clustered
    middles = vector_index.centroids(vectors)
    held = vector_index.stored(vector_index.assigned(vectors, middles))
    got, first, after = vector_index._nearest(held, middles, asked.collect(), 10)
    assert rows(got) == rows(semantic.nearest(vectors, asked, 10))
    lists = held.select("list").distinct().count()
    read = sum(n < 20 for n, _ in first + after)
    assert lists > 20 and read * 3 < 8 * lists
    monkeypatch.setattr(vector_index, "FIRST", 400)
    assert rows(vector_index.nearest(held, middles, asked, 200)) == rows(semantic.nearest(vectors, asked, 200))


def test_later_vectors_join_the_lists(spark, clustered):
    vectors, asked = clustered
    middles = vector_index.centroids(vectors.where("id < 500"), 5)
    held = vector_index.assigned(vectors, middles)
    assert held.where("list < 0").count() == 2  # a length without centroids
    assert rows(vector_index.nearest(held, middles, asked, 7)) == rows(semantic.nearest(vectors, asked, 7))
    none = vectors.limit(0)
    middles = vector_index.centroids(none)
    assert vector_index.nearest(vector_index.assigned(none, middles), middles, asked, 3).collect() == []


def test_random_directions(spark):
    """Where nothing can be left out, all is read."""
    r = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, r.normal(size=24).tolist()) for i in range(400)], VECTORS)
    asked = spark.createDataFrame([(i, r.normal(size=24).tolist()) for i in range(5)], ASKED)
    middles = vector_index.centroids(vectors)
    assert rows(vector_index.nearest(vector_index.assigned(vectors, middles), middles, asked, 9)) == rows(semantic.nearest(vectors, asked, 9))

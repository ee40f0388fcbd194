"""The best of a search by bounds of windows are those of the whole search, and less is read for fewer of them."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF, same_as_oracle
from seekframe.operators import lexical
from seekframe.plans import catalogue, stored

FILES = "project string, path string, content string"
QUERIES = [(1, "alpha beta"), (2, "gamma"), (3, "alpha gamma delta rare"), (4, "nowhere"), (5, "delta")]


@pytest.fixture(scope="module")
def index(spark):
    r = random.Random(12)
    words = ["alpha"] * 9 + ["beta"] * 3 + ["gamma"] * 2 + ["delta"] + [f"w{n}" for n in range(60)]
    rows = []
    for i in range(3000):
        heavy = i % 251 == 0
        text = " ".join(r.choice(words[:15] if heavy and r.random() < 0.8 else words) for _ in range(r.choice([5, 20, 60, 200])))
        rows.append(("pq"[i % 2], f"d/f{i:05}.txt", text + (" rare" if i % 400 == 1 else "")))
    files = spark.createDataFrame(rows, FILES)
    fields, postings = lexical.build(files, 256)
    fields, postings = fields.cache(), postings.cache()
    yield fields, postings, lexical.blocks(postings).cache()
    fields.unpersist(), postings.unpersist()


def best(hits, limit):
    return sorted((x["query_id"], x["project"], x["rank"], x["path"], round(x["score"], 9)) for x in lexical.top(hits, limit).collect())


@pytest.mark.parametrize("limit", [1, 10, 5000])
def test_same_best(spark, monkeypatch, index, limit):
    monkeypatch.setattr(lexical, "WHOLE", 0)
    monkeypatch.setattr(lexical, "FIRST", 2)
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    whole = lexical.search(*index[:2], asked)
    some = lexical.search_best(*index, asked, limit)
    assert best(some, limit) == best(whole, limit)
    assert limit > 1 or some.count() < whole.count() // 2
    assert lexical.search_best(*index, asked.where("query_id = 4"), limit).isEmpty()


def test_fewer_windows_for_fewer_results(spark, monkeypatch, index):
    """What the scan is asked for falls with the limit."""
    monkeypatch.setattr(lexical, "WHOLE", 0)
    kept, read = lexical.keep, {}
    asked = spark.createDataFrame(QUERIES[:3], "query_id int, query string")
    for limit in (1, 20, 400):
        seen = []
        monkeypatch.setattr(lexical, "keep", lambda df, label: seen.append((label, out := kept(df, label))) or out)
        lexical.search_best(*index, asked, limit)
        tables = dict(seen)
        first = tables["bounds"].where(F.col("before") < lexical.FIRST * limit).select("query_id", "project", "window")
        read[limit] = first.unionByName(tables["rest"].select("query_id", "project", "window")).distinct().count()
    assert read[1] < read[20] < read[400] and read[1] * 2 < read[400]


def test_queries_by_bounds(spark, duck, monkeypatch):
    monkeypatch.setattr(lexical, "WHOLE", 0)
    for name in ("lexical_bm25_topk", "federated_topk"):
        same_as_oracle(spark, duck, catalogue.queries()[name], catalogue.oracle_sql()[name])
    assert stored.index(spark, SF, F.lit("all"))[2].count() > 0

"""Bounds of the top-k search keep the best on uneven components, and few rounds of reading are enough."""

import numpy as np
import pytest

from seekframe.llm import topk_search


@pytest.mark.parametrize("kind", ["even", "heavy", "sparse", "equal"])
def test_best_survive(kind):
    r = np.random.default_rng(6)
    vectors = {"even": lambda: r.normal(size=(3000, 32)) * 256, "heavy": lambda: r.standard_cauchy(size=(3000, 32)) * 50, "sparse": lambda: r.normal(size=(3000, 32)) * 256 * (r.random((3000, 32)) < 0.1), "equal": lambda: np.full((3000, 32), 7.0)}[kind]()
    vectors = np.floor(vectors)
    lists, ids = topk_search.Lists(vectors), r.permutation(3000)
    for i in range(0, 3000, 100):
        own = np.array([i])
        at, scores = lists.best(vectors[i], own, ids, 5)
        whole = (vectors @ vectors[i]).astype(np.int64)
        told = [j for j in np.lexsort((ids, -whole)).tolist() if j != i][:5]
        assert at.tolist() == told and scores.tolist() == whole[told].tolist()


def test_few_rounds(monkeypatch):
    r = np.random.default_rng(7)
    vectors = np.floor(256 * r.normal(size=(4000, 64)))
    lists, partition, rounds = topk_search.Lists(vectors), np.partition, []
    monkeypatch.setattr(topk_search.np, "partition", lambda *a, **k: rounds.append(1) or partition(*a, **k))
    for i in range(20):
        assert i in lists.survivors(vectors[i], 6)
    assert len(rounds) <= 2 * 20

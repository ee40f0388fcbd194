"""Selections under a budget over every document, against folds that read all items in order."""

import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import Row

from seekframe.operators import budget
from seekframe.plans import queries

#: About fifty documents a source.
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lists(spark):
    """Each source's items in order."""
    out = defaultdict(list)
    for r in queries._items(spark, SF).collect():
        out[r["query_id"]].append(r)
    return {p: sorted(rows, key=lambda r: (-round(r["score"], 9), r["path"])) for p, rows in out.items()}


def estimate(text):
    return -(-len(text) * 2 // 7)


def truncated(content, tokens):
    """(text, lines) tried line by line, then character by character."""
    lines = re.split("\r\n|[\n\v\f\r\x85\u2028\u2029]", content)
    for n in range(len(lines), 0, -1):
        text = "\n".join([*lines[:n], budget.MARK])
        if estimate(text) <= tokens:
            return (text if n < len(lines) else "\n".join(lines)), n
    for n in range(len(lines[0]), -1, -1):
        text = f"{lines[0][:n]}\n{budget.MARK}"
        if estimate(text) <= tokens:
            return text, 1
    return "", 0


def greedy(items, total):
    left, out = total, []
    for r in items:
        if r["tokens"] <= min(left, max(24, total // 2)):
            left -= r["tokens"]
            out.append((r["path"], r["tokens"]))
    return out


def truncating(items, total):
    left, out = total, []
    for r in items:
        allowed, need, cut = min(left, max(24, total // 2)), estimate(r["content"]), False
        if need > allowed:
            if allowed < 24:
                continue
            text, _ = truncated(r["content"], allowed)
            need, cut = estimate(text), True
            if not text.strip() or need > left:
                continue
        left -= need
        out.append((r["path"], need, cut))
    return out


def federated(lists, fair, total):
    """lists: by project place, each of (path, content, tokens)."""
    used, seen, closed, later, out, spent = defaultdict(int), set(), set(), [], [], 0
    for n in range(max(map(len, lists))):
        for p, items in enumerate(lists):
            if n < len(items):
                path, content, tokens = items[n]
                same = " ".join(content.split())
                if p in closed or used[p] + tokens > fair[p] or spent + tokens > total:
                    closed.add(p)
                    later.append((path, same, tokens))
                elif same not in seen:
                    seen.add(same)
                    used[p] += tokens
                    spent += tokens
                    out.append((path, False))
    for path, same, tokens in later:
        if spent + tokens <= total and same not in seen:
            seen.add(same)
            spent += tokens
            out.append((path, True))
    return out


def test_every_document_counts(spark, lists):
    documents = spark.read.parquet(os.path.join(SF, "documents.parquet")).count()
    assert sum(map(len, lists.values())) == documents
    took = defaultdict(list)
    for r in queries.greedy_budget_selection(spark, SF).orderBy("place").collect():
        took[r["project"]].append((r["path"], r["tokens"]))
    assert took == {p: greedy(rows, queries.BUDGET) for p, rows in lists.items()}
    for r in queries.context_bundle_summary(spark, SF).collect():
        assert (r["available"], r["items"]) == (sum(x["tokens"] for x in lists[r["project"]]), len(took[r["project"]]))
    cut = defaultdict(set)
    for r in queries.greedy_budget_truncating(spark, SF).collect():
        cut[r["project"]].add((r["path"], r["tokens"], r["cut"]))
    assert cut == {p: set(truncating(rows, queries.BUDGET)) for p, rows in lists.items()}


@pytest.mark.parametrize("seed", range(3))
def test_long_lists(spark, seed):
    """Lists of many small items, with copies, empty ones and white space."""
    r = random.Random(seed)
    texts = ["", " \r\n" * 90, "\r\n".join("ab" * 9 for _ in range(40))] + ["x" * r.randint(1, 9) for _ in range(40)] + [f"a  b{n}\n" * r.randint(1, 60) for n in range(60)]
    items = [[(f"{p}-{n:04}", t := r.choice(texts) + " " * r.choice([0, 0, 4]), estimate(t)) for n in range(700)] for p in range(3)]
    total = 300
    rows = [Row(query_id=p, path=path, start_line=1, end_line=t.count("\n") + 1, tokens=k, score=1.0, content=t) for p, own in enumerate(items) for path, t, k in own]
    df = spark.createDataFrame(rows)
    got = sorted((x["query_id"], x["place"], x["path"], x["tokens"]) for x in budget.greedy(df, total).collect())
    assert got == [(p, n + 1, *x) for p, own in enumerate(items) for n, x in enumerate(greedy([{"path": a, "tokens": k} for a, _, k in own], total))]
    got = sorted((x["query_id"], x["path"], x["tokens"], x["cut"]) for x in budget.greedy_truncating(df, total).collect())
    assert got == [(p, *x) for p, own in enumerate(items) for x in truncating([{"path": a, "content": t} for a, t, _ in own], total)]
    fair = [r.choice([9, 60, 100]) for _ in items]
    rows = [Row(query_id=1, project=str(p), project_place=p, item_place=n, type="FILE", path=path, content=t, tokens=k, fair=fair[p]) for p, own in enumerate(items) for n, (path, t, k) in enumerate(own)]
    got = [(x["path"], x["refill"]) for x in budget.federated(spark.createDataFrame(rows), total).orderBy("place").collect()]
    assert got == federated(items, fair, total)


def offered(spark, items, fair):
    rows = [Row(query_id=1, project=str(p), project_place=p, item_place=n, path=path, same=" ".join(t.split()), tokens=k, fair=fair[p]) for p, own in enumerate(items) for n, (path, t, k) in enumerate(own)]
    return spark.createDataFrame(rows)


@pytest.mark.parametrize("seed", range(4))
def test_fair_parts_of_repeated_contents(spark, monkeypatch, seed):
    """Contents that projects share, that repeat within one, and that have several sizes; cut as soon as anything can be."""
    monkeypatch.setattr(budget, "PROJECTS_MOST", 5)
    monkeypatch.setattr(budget, "PLACES", 16)
    r = random.Random(seed)
    total = r.choice([20, 60])
    pools = [[f"c{r.randint(0, 400 if p % 2 else 12)}" for _ in range(150)] for p in range(5)]
    items = [[(f"{p}-{n:04}", t := r.choice(pools[p]), r.choice([1, 1, 2, 5, 30]) if r.random() < 0.2 else 1 + len(t) % 3) for n in range(300)] for p in range(5)]
    fair = [r.choice([3, 10, total // 2]) for _ in items]
    got = [(x["path"], x["refill"]) for x in budget.federated(offered(spark, items, fair), total).orderBy("place").collect()]
    assert got == federated(items, fair, total)


def test_fold_follows_the_budget(spark):
    """A million small items, and as many copies of one, leave a short list."""
    total = 200
    small = spark.range(1_000_000).selectExpr("1 as query_id", "'a' as project", "0 as project_place", "id as item_place", "concat('a', id) as path", "cast(id as string) as same", "40 as tokens", "100 as fair")
    copies = spark.range(300_000).selectExpr("1 as query_id", "'b' as project", "1 as project_place", "id as item_place", "concat('b', id) as path", "'one' as same", "30 as tokens", "100 as fair")
    both = small.unionByName(copies)
    assert budget._offered(both, total, "query_id").count() <= 4 * (total + budget.PROJECTS_MOST)
    got = [(x["path"], x["refill"]) for x in budget.federated(both, total).orderBy("place").collect()]
    assert got == [("a0", False), ("b0", False), ("a1", False), ("a2", True), ("a3", True)]

"""Symbols found by their parts against all symbols compared, and what the scan is asked for."""

import random

from conftest import SF
from seekframe.operators import symbol_index, symbols
from seekframe.plans import catalogue

SYMBOLS = "path string, kind string, name string, qualified string, start_line int, end_line int, provider string"


def test_same_as_a_scan(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abAB_éİ") for _ in range(r.randint(0, 9)))
    rows = [(f"p{i % 50}", "CLASS", n := word(), f"x.{word()}.{n}", i, i + 1, "builtin") for i in range(900)]
    rows += [("q", "CLASS", "Repeated", "a.Repeated", 1, 2, "builtin")] * 3 + [("q", "TYPE", None, "only.Qualified", 1, 2, "ext"), ("q", "TYPE", "OnlyName", None, 1, 2, "ext")]
    df = spark.createDataFrame(rows, SYMBOLS)
    index = symbol_index.build(df)
    asks = ["aba", "ab", "a", "repeated", "rep.eat", "qualified", "onlyname", "abab_ab", "éab", "zzzzzz", "İa"]
    order = ["query", "place"]
    for limit in (7, 5000):
        got = symbols.find(df, asks, limit, index).drop("place").collect()
        want = symbols.find(df, asks, limit).drop("place").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    got, want = (symbols.scored(df, ["Aba rep", "only qualified x", "ab"], 40, 20, x).orderBy(*order).collect() for x in (index, None))
    assert got == want and got


def test_pushed_filter(spark):
    for name in ("symbol_search_ranked", "symbol_scored_candidates"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(term" in plan or "PushedFilters: [Or(" in plan or "In(term" in plan, plan

"""Frequent phrases and their scores against plain counting."""

import random
import re
from collections import Counter

import pytest

from conftest import SF, same_as_oracle
from seekframe.llm import collocations
from seekframe.llm.scratch import ship

DOCS = "doc_id long, text string, lang string, block int, n int, phrase string, row int"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]


def brute(rows, least, longest, top, share):
    f, words = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            words[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    often = {p: n for p, n in f.items() if n >= least and len(p[1]) > 1}
    for (lang, p), a in often.items():
        cuts = [(1000 * a * words[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = [n for (x, q), n in often.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * n >= share * a for n in inside):
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], words[lang]))
    out.sort()
    ranks, rows = Counter(), []
    for lang, score, a, p, le, r, n in out:
        ranks[lang] += 1
        if top is None or ranks[lang] <= top:
            rows.append((lang, ranks[lang], p.decode(), -a, le, r, n, -score))
    return sorted(rows)


def odd_rows():
    r = random.Random(8)
    vocabulary = ["The", "the", "cat", "Ä", "ä", " x", "sat", "on", "mat", "q" * 90, "q" * 90 + "z", "日本", "'", "-"]
    rows = []
    for i in range(500):
        words = [r.choice(vocabulary) if r.random() < 0.7 else f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 40))]
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "!", "\x0b", "\r\n"]) for w in words)
        rows.append((r.choice([i, 7, None]), text, r.choice(["en", "en", "en", "de", None, "", "und"])))
    rows += [(1, None, "en"), (2, "", "xx"), (3, "...", "yy"), (4, "a b " * 300, "long"), (5, "once upon a time " * 30, "long"), (6, "x" * 30000 + " y", "long")]
    rows += [(9, "the same row again and again", "en")] * 40
    return [(*x, 1, 2, "p", 3) for x in rows]


@pytest.mark.parametrize("least,longest,top,share,block", [(5, 5, None, 100, 700), (5, 3, 6, 60, 1 << 20), (1, 2, 50, 100, 5000)])
def test_mine(spark, monkeypatch, least, longest, top, share, block):
    monkeypatch.setattr(collocations, "RANGE_BITS", 13)
    monkeypatch.setattr(collocations.frequent, "__defaults__", (*collocations.frequent.__defaults__[:-1], block))
    rows = odd_rows()
    got = collocations.mine(spark.createDataFrame(rows, DOCS), least, longest, top, share)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, least, longest, top, share)


def test_crowded_sketch(spark, monkeypatch):
    """A sketch in which nearly every cell is full only costs time."""
    rows = odd_rows()
    monkeypatch.setattr(collocations, "BYTES_PER_CELL", 1 << 30)
    monkeypatch.setattr(collocations, "cells", lambda h, row, bits: (h >> collocations.U64(61)) + collocations.U64(row))
    got = collocations.mine(spark.createDataFrame(rows, DOCS), 5)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 5, 5, 2000, 100)


def test_exact_products(spark):
    """Scores whose products pass 64 bits."""
    big = 10**15 + 7
    df = spark.createDataFrame([(big, big * 90 + 1, big + 11, big + 13)], "f long, words long, l long, r long")
    assert df.selectExpr(f"{collocations.SCORE} as s").first()["s"] == 1000 * big * (big * 90 + 1) // ((big + 11) * (big + 13))


def test_numbers():
    import numpy as np

    for values in ([], [0, 1, 254, 255, 256, 70000, 3], [255] * 5):
        a = np.array(values, np.int64)
        assert collocations.read_numbers(collocations.numbers(a), len(a)).tolist() == values


def test_defined_ends(spark):
    none = spark.createDataFrame([], DOCS)
    assert collocations.mine(none).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, None, None, 1, 1, "", 1), (2, "..", "en", 1, 1, "", 1)], DOCS), 1).collect() == []
    with pytest.raises(ValueError):
        collocations.mine(none, 0)


def test_oracle(spark, duck):
    same_as_oracle(spark, duck, collocations.op12_collocations, collocations.OP12_SQL)

"""Nodes against a trie of dictionaries, whichever way the buckets are finished."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from conftest import SF, same_as_oracle
from seekframe.llm import prefix_trie
from seekframe.llm.scratch import Scratch, ship

TALKS = "conv_id long, turn long, role string, text string, b long, pos int, n int"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def ordered(rows):
    talks = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            talks[conv].append((turn is not None, turn or 0, told, role, text))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in talks.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(talks):
    members = defaultdict(list)
    for c, x in talks.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = defaultdict(list)
    for c, x in talks.items():
        ends[tuple(x)].append(c)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


def rows_of(df):
    got = [tuple(r) for r in df.select(prefix_trie.COLUMNS).collect()]
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got)


def odd_rows():
    r = random.Random(6)
    rows = []
    for c in range(80):
        shared = [("user", f"s{k}") for k in range(r.choice([0, 3, 12, 20]))] if c % 3 else []
        own = [(r.choice(["user", None, ""]), r.choice(["hi", "é", "", None, "go on"])) for _ in range(r.choice([0, 1, 2, 9, 20]))]
        for k, (role, text) in enumerate(shared + own):
            rows.append((c if c % 7 else c + 1000, r.choice([k, k, k * 700]) if c % 5 else k, role, text))
    rows += [(77, None, "user", "first"), (78, None, "user", "first"), (77, 5, None, None), (77, 5, "user", "hi"), (77, 5, "user", "hi"), (None, 1, "user", "none"), (-3, 2, "x", "y"), (-5, 1, "x", "y")]
    rows += [(2000 + i, 1, "user", "the same") for i in range(60)]
    r.shuffle(rows)
    return [(*x, 1, 2, 3) for x in rows]


@pytest.mark.parametrize("local,segment,bits", [(50_000, 16, 10), (60, 8, 2), (3, 4, 0)])
def test_trie(spark, monkeypatch, local, segment, bits):
    for name, value in (("LOCAL", local), ("SEGMENT", segment), ("BLOCK_BITS", bits), ("PART_BITS", 3), ("PART", 8)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = odd_rows()
    if local == 3:  # many rounds
        rows = [x for x in rows if x[0] is None or x[0] < 9 or x[0] > 2052]
    df = spark.createDataFrame(rows, TALKS)
    assert rows_of(prefix_trie.build(df)) == brute(ordered(rows))
    if local == 60:
        scratch = Scratch(spark, "t")
        got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.encoded(df, scratch), scratch), scratch)
        assert rows_of(got) == brute(rebuilt(ordered(rows)))


def test_comb(spark, monkeypatch):
    """Conversations that end one turn after another along one path, with copies."""
    monkeypatch.setattr(prefix_trie, "LOCAL", 20)
    rows = [(c, t, "user", f"t{t}", 1, 1, 1) for c in range(12) for t in range(c % 6)] + [(500 + c, t, "user", f"t{t}", 1, 1, 1) for c in range(8) for t in range(5)]
    assert rows_of(prefix_trie.build(spark.createDataFrame(rows, TALKS))) == brute(ordered(rows))


def test_defined_ends(spark):
    assert prefix_trie.build(spark.createDataFrame([], TALKS)).collect() == []
    assert prefix_trie.build(spark.createDataFrame([(None, 1, "a", "b", 1, 1, 1)], TALKS)).collect() == []
    rows = [(4, None, None, None, 1, 1, 1)]
    assert rows_of(prefix_trie.build(spark.createDataFrame(rows, TALKS))) == brute(ordered(rows))


def test_oracle(spark, duck):
    same_as_oracle(spark, duck, prefix_trie.op11_prefix_trie, prefix_trie.OP11_SQL)


def test_query_by_brute_force(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(prefix_trie.op11_prefix_trie(spark, SF)) == brute(rebuilt(ordered(rows)))

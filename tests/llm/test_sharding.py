"""Packing against plain best fit, group by group, and placing on odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF
from seekframe.llm import sharding

DOCS = "doc_id long, text string, w int, g int, m int, shard int, slot int"


def plain(sizes, capacity):
    """Loads when each group by itself goes into the tightest shard."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fit = [n for n, room in enumerate(rooms) if room >= size]
        if fit:
            rooms[min(fit, key=lambda n: rooms[n])] -= size
        else:
            rooms.append(max(capacity, size) - size)
    return len(rooms), sorted(rooms)


def counted(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def loads(runs):
    out = Counter()
    for size, n, shard in runs:
        out[shard] += size * n
    return out


@pytest.mark.parametrize("seed", range(8))
def test_best_fit(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randint(1, 1000), r.randint(1, 50), 7]) for _ in range(2000)]
    capacity = r.choice([400, 1000, 5000])
    runs = sharding.best_fit(counted(sizes), capacity)
    held = loads(runs)
    shards, rooms = plain(sizes, capacity)
    over = [x for x in held.values() if x > capacity]
    assert len(held) == shards == max(held) + 1
    assert sorted(max(capacity, x) - x for x in held.values()) == rooms
    assert sorted(over) == sorted(x for x in sizes if x > capacity)
    assert Counter(s for s, n, _ in runs for _ in range(n)) == Counter(sizes)


def test_tree():
    r, tree, plain_set = random.Random(2), sharding.Tree(), set()
    for _ in range(4000):
        key = (r.randint(0, 99), r.randint(0, 9))
        if r.random() < 0.5 and key not in plain_set:
            tree.add(key)
            plain_set.add(key)
        else:
            want = min((k for k in plain_set if k >= key), default=None)
            assert tree.pop_from(key) == want
            plain_set.discard(want)


@pytest.mark.parametrize("sizes", [[5], [7] * 17, [10**6] + [3] * 1000, [100, 100, 1], list(range(1, 500)), [10**6, 10**6, 10**6] + [10] * 50, [1] * 15])
def test_even(sizes):
    runs = sharding.even(counted(sizes), 16)
    held = loads(runs)
    assert Counter(s for s, n, _ in runs for _ in range(n)) == Counter(sizes)
    assert set(held) <= set(range(16))
    alone = {s for s in held if sum(n for _, n, x in runs if x == s) == 1}
    rest = [held[s] for s in range(16) if s not in alone]
    if rest and set(range(16)) - alone <= set(held):
        smallest = min(sizes)
        assert max(rest) - min(rest) <= max(smallest, min(s for s, _, x in runs if held[x] == max(rest)))
    assert sharding.even([], 16) == []


def check(got, rows):
    """What holds of every packing."""
    text = Counter((i, (t or "").encode()) for i, t, *_ in rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == Counter({(i, len(t) + 1, zlib.crc32(t)): n for (i, t), n in text.items()})
    slots = defaultdict(list)
    for x in got:
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = defaultdict(set)
    for x in got:
        place[(x["size"], x["text_crc32"])].add(x["shard"])
    assert all(len(s) == 1 for s in place.values())


def odd_rows():
    r = random.Random(4)
    texts = [None, "", "é" * 40000, "a" * 70000, "copy of many"] + ["".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 30))) for _ in range(300)]
    rows = [(i, r.choice(texts)) for i in range(700)] + [(1000 + i, "copy of many") for i in range(400)] + [(None, "x"), (None, None), (3, "y"), (3, "y"), (3, "z")]
    return [(*x, 1, 2, 3, 4, 5) for x in rows]


@pytest.mark.parametrize("buckets", [(4096, 65536, 64), (3, 7, 2)])
def test_pack(spark, monkeypatch, buckets):
    for name, value in zip(("SIZE_BUCKETS", "SLOT_BUCKETS", "STEP"), buckets, strict=True):
        monkeypatch.setattr(sharding, name, value)
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS)
    got = sharding.pack(df, shards=5).collect()
    check(got, rows)
    held = Counter()
    for x in got:
        held[x["shard"]] += x["size"]
    assert set(held) == set(range(5))
    groups = Counter()
    for _, t, *_ in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    small = sorted(held[s] for s in held if held[s] not in set(groups.values()))
    assert len(small) == 3 and small[-1] - small[0] <= 64

    capacity = 3000
    got = sharding.pack(df, capacity=capacity).collect()
    check(got, rows)
    held = Counter()
    for x in got:
        held[x["shard"]] += x["size"]
    assert (len(held), sorted(max(capacity, x) - x for x in held.values())) == plain(groups.values(), capacity)


def test_defined_ends(spark):
    none = spark.createDataFrame([], DOCS)
    assert sharding.pack(none, shards=4).collect() == [] and sharding.pack(none, capacity=4).collect() == []
    one = sharding.pack(spark.createDataFrame([(7, None, 1, 1, 1, 1, 1)], DOCS), shards=4).collect()
    assert [tuple(x) for x in one] == [(7, 1, 0, 0, 0)]
    for wrong in ({}, {"shards": 0}, {"capacity": 2, "shards": 2}):
        with pytest.raises(ValueError):
            sharding.pack(none, **wrong)
    w = [1, 65535, 65536, 65537, 131071, 131072, 131073, 131075, (1 << 40) + 1]
    got = [x["r"] for x in spark.createDataFrame([(x,) for x in w], "w long").select(sharding.rounded(F.col("w")).alias("r")).collect()]
    assert got == [1, 65535, 65536, 65538, 131072, 131072, 131076, 131076, (1 << 40) + (1 << 25)]


def test_query(spark):
    got = sharding.op13_sharding(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = got.collect()
    check(got, docs)
    held = Counter()
    for x in got:
        held[x["shard"]] += x["size"]
    assert {x["law"] for x in got} == {"bytes"} and set(held) == set(range(16))

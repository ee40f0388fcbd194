"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Rows of equal text are a group, and a group is never divided. Groups go in order of falling size, each into the shard with the
least room that still takes it; shards are kept by room in a balanced tree. Groups of one size are alike, so the packing needs
only how many groups there are of each size: it goes through sizes, not groups, and gives runs (of this size, the groups from
here to there go to that shard), which joins then carry to the groups. Sizes from 2^16 on are rounded up to 16 binary places,
so that there are at most ``SIZES`` of them however much text there is; only their counts come to the driver.

With ``capacity``: as few shards as best fit opens, none above the capacity but those of a single larger group. With ``shards``: a
group of more than its even part gets a shard of its own; the others are packed at the least capacity, found by bisection, at
which they fit into the shards that are left; then groups go from the fullest to the emptiest of these while that brings the two
closer. Two such shards differ by at most the smallest group of the fuller one.

Which groups of a size are meant is told by their rank, counted in buckets of a hash, so no size, however common, is ranked in one
task; nor is a shard when its rows get their slots (0, 1, ... in each shard, in no particular order).

A null text has no bytes and goes with the empty ones. Null ids are rows like others; rows that repeat are each placed, together.
No rows: no rows. Fewer groups than shards: some shards stay empty. Other columns of the input are not read.
"""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.llm.scratch import Scratch
from seekframe.tables import table

PLACES = 16
#: The most sizes that 2^63 bytes can have.
SIZES = (1 << PLACES) + (63 - PLACES) * (1 << (PLACES - 1))
SHARDS = 16
#: Buckets in which the groups of a size, and the rows of all shards, are counted.
SIZE_BUCKETS, SLOT_BUCKETS = 4096, 65536
#: Ranks that meet a run's ranks at once.
STEP = 64
RUNS = pa.schema([("w", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("shard", pa.int32()), ("only", pa.bool_())])
Run = tuple[int, int, int]  # size, groups, shard


class Tree:
    """A set of (room, shard), balanced by random priorities."""

    def __init__(self):
        self.root, self.random = None, random.Random(13)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.random.random(), None, None]), high)

    def pop_from(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Remove the least member that isn't below ``key``; None if all are."""
        low, high = self._split(self.root, key)
        if high is None:
            self.root = low
            return None
        above, node = None, high
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            high = node[3]
        else:
            above[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low if high is None else high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high


def best_fit(sizes: list[tuple[int, int]], capacity: int, most: int | None = None, first: int = 0) -> list[Run] | None:
    """Runs for (size, groups) in falling order of size; None if that takes more than ``most`` shards. Shards count from ``first``."""
    tree, runs, opened = Tree(), [], 0
    for size, left in sizes:
        while left:
            found = tree.pop_from((size, -1))
            if found is None:
                if opened == most:
                    return None
                found = (max(capacity, size), first + opened)
                opened += 1
            room, shard = found
            n = min(left, room // size)
            runs.append((size, n, shard))
            left -= n
            if room > n * size:
                tree.add((room - n * size, shard))
    return runs


def level(runs: list[Run], first: int, shards: int) -> list[Run]:
    """Groups go from the fullest to the emptiest of the shards ``first`` to ``shards - 1`` while that brings the two closer."""
    held = {s: Counter() for s in range(first, shards)}
    for size, n, shard in runs:
        held[shard][size] += n
    load = {s: sum(size * n for size, n in held[s].items()) for s in held}
    while held:
        full, empty = max(load, key=load.get), min(load, key=load.get)
        apart = load[full] - load[empty]
        moves = [size for size, n in held[full].items() if n and size < apart]
        if not moves:
            break
        halves = [size for size in moves if 2 * size <= apart]
        size = max(halves) if halves else min(moves)
        n = min(held[full][size], max(1, apart // (2 * size)))
        held[full][size] -= n
        held[empty][size] += n
        load[full] -= n * size
        load[empty] += n * size
    return [(size, n, s) for s in held for size, n in held[s].items() if n]


def even(sizes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs that fill a given number of shards as evenly as whole groups allow."""
    left, total, runs = [list(x) for x in sizes], sum(size * n for size, n in sizes), []
    while left and len(runs) < shards - 1 and left[0][0] * (shards - len(runs)) >= total:
        runs.append((left[0][0], 1, len(runs)))
        total -= left[0][0]
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    if not left:
        return runs
    own = len(runs)
    rest, bins = [tuple(x) for x in left], shards - own
    low = max(left[0][0], -(-total // bins))  # nothing less can do, and the sum with a group more always does
    high, best = low + left[0][0], None
    if (found := best_fit(rest, low, bins, own)) is not None:
        best = found
    else:
        best = best_fit(rest, high, bins, own)
        while high - low > 1:
            mid = (low + high) // 2
            found = best_fit(rest, mid, bins, own)
            if found is None:
                low = mid
            else:
                high, best = mid, found
    return runs + level(best, own, shards)


def rounded(size: Column) -> Column:
    """Sizes up to 16 binary places as they are, larger ones rounded up to as many."""
    low = F.greatest(F.length(F.bin(size)) - PLACES, F.lit(0))
    step = F.pow(F.lit(2.0), low).cast("long")
    return size + step - 1 - F.pmod(size + step - 1, step)


def _table(runs: list[Run]) -> pa.Table:
    """Runs with the ranks that they take of their size, the first shard's first."""
    times, at, rows = Counter(size for size, _, _ in runs), Counter(), []
    for size, n, shard in sorted(runs, key=lambda r: (-r[0], r[2])):
        rows.append((size, at[size], at[size] + n, shard, times[size] == 1))
        at[size] += n
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUNS.types, strict=True)], schema=RUNS) if rows else RUNS.empty_table()


def pack(docs: DataFrame, capacity: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row; either ``capacity``, in bytes with one more for each row, or ``shards`` is given."""
    if (capacity is None) == (shards is None) or (capacity if shards is None else shards) < 1:
        raise ValueError("either a capacity or a number of shards, of at least 1")
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("g"))
    rows = scratch.keep(source.withColumn("m", F.monotonically_increasing_id()))
    w = F.col("bytes")
    size = rounded(w)
    if capacity is not None:  # what fits still does once rounded
        size = F.when(w <= capacity, F.least(size, F.lit(capacity))).otherwise(size)
    groups = scratch.keep(rows.groupBy("g").agg(F.sum("size").alias("bytes")).select("g", size.alias("w")))
    counts = groups.groupBy("w").agg(F.count("*").alias("n")).toArrow()  # a row a size
    sizes = sorted(zip(counts["w"].to_pylist(), counts["n"].to_pylist(), strict=True), reverse=True)
    runs = best_fit(sizes, capacity) if shards is None else even(sizes, shards)
    plan = scratch.keep(spark.createDataFrame(_table(runs)))
    located = scratch.keep(rows.join(scratch.keep(_placed(groups, plan)), "g").select("id", "size", "crc", "m", "shard"))
    scratch.drop(rows, groups)
    return _numbered(located, scratch, 1 + max((s for _, _, s in runs), default=0)).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _placed(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """(g, shard): sizes that go to one shard by a plain join, the others by rank."""
    whole = groups.join(plan.where("only").select("w", "shard"), "w").select("g", "shard")
    parts = plan.where("not only")
    some = groups.join(parts.select("w").distinct(), "w", "left_semi").withColumn("b", F.pmod(F.xxhash64("g"), F.lit(SIZE_BUCKETS)))
    sums = some.groupBy("w", "b").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(W.partitionBy("w").orderBy("b")) - F.col("n")).alias("before")
    within = F.row_number().over(W.partitionBy("w", "b").orderBy("g"))
    ranked = some.withColumn("r", within).join(sums.select("w", "b", before), ["w", "b"]).select("w", "g", (F.col("before") + F.col("r") - 1).alias("r"))
    met = F.explode(F.sequence(F.expr(f"first div {STEP}"), F.expr(f"(last - 1) div {STEP}"))).alias("s")
    found = ranked.withColumn("s", F.expr(f"r div {STEP}")).join(parts.select("w", met, "first", "last", "shard"), ["w", "s"]).where("first <= r and r < last")
    return whole.unionByName(found.select("g", "shard"))


def _numbered(located: DataFrame, scratch: Scratch, shards: int) -> DataFrame:
    """Rows with their slots, counted in buckets of each shard."""
    rows = located.withColumn("b", F.pmod(F.xxhash64("m"), F.lit(max(1, SLOT_BUCKETS // shards))))
    sums = rows.groupBy("shard", "b").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(W.partitionBy("shard").orderBy("b")) - F.col("n")).alias("before")
    offsets = scratch.keep(sums.select("shard", "b", before))
    within = F.row_number().over(W.partitionBy("shard", "b").orderBy("m"))
    return rows.withColumn("r", within).join(offsets, ["shard", "b"]).withColumn("slot", (F.col("before") + F.col("r") - 1).cast("long"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, copies of a text together."""
    out = pack(table(spark, sf_dir, "documents"), shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

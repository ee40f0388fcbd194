"""Conversation prefix trie: MSD radix partitioning over turn ids, buckets finished by multikey quicksort.

A conversation's turns, in order, are a string over the alphabet of distinct turns; every distinct beginning is a node of the trie.

Turns. Each distinct (role, text), told by SHA-256, gets a number from a dictionary table; texts are read once and never shuffled. A turn's
place is counted in blocks of ``BLOCK`` turn numbers, and turns are kept ``SEGMENT`` to a row, so that no conversation meets in one row.

Radix partitioning. A bucket is the set of conversations below a node, named by its smallest member and its depth. Round by round each
open bucket skips what all of its members share of the segment (every member is compared with the smallest), then is dealt by the next
turn. The nodes on the way are emitted from counts. A bucket of one conversation is a chain, emitted from its length; one of at most
``LOCAL`` members and turns is finished in a task; larger ones stay open for the next round. Small buckets share tasks of about that size.

Finishing. Multikey quicksort: members are parted in three by the turn of one of them; equal ones share one more turn, which is a node, and
go on with the next. What is below an open bucket is summed up round by round from the last one back.

Ties of turn number go by the turn's digest; null turn numbers come first; null roles and texts are empty; rows without a conversation
id belong to none. Rows that repeat are turns of their own. No rows: no nodes, not even a root. Other columns aren't read. A node's own
conversations (``ends_sha256``) are digested as a sorted stream of parts, so no row holds them all. Rounds are as many as open buckets divide one
below another, or share segments: few, unless very many conversations share a very long beginning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.llm.scratch import Scratch
from seekframe.tables import table

BLOCK_BITS, SEGMENT, LOCAL = 10, 64, 50_000
PART_BITS = 12
PART = 1 << PART_BITS
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]
FAMILY, HEAD = 5, 9


def encoded(conversations: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, tid, bytes): turns by number, with their place from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    told = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    block = F.coalesce(F.shiftright(F.col("turn"), BLOCK_BITS), F.lit(-(1 << 62)))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), told.alias("told"), F.octet_length(text).cast("long").alias("bytes"))
    rows = scratch.keep(rows.where("conv_id is not null").withColumn("block", block))
    names = scratch.keep(rows.select("told").distinct().withColumn("tid", F.monotonically_increasing_id()))
    sums = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(W.partitionBy("conv_id").orderBy("block")) - F.col("n")).alias("before")
    offsets = scratch.keep(sums.select("conv_id", "block", before).where("before > 0"))
    within = F.row_number().over(W.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "told")) - 1
    placed = rows.withColumn("r", within).join(offsets, ["conv_id", "block"], "left")
    placed = placed.select("conv_id", (F.col("r") + F.coalesce("before", F.lit(0))).alias("pos"), "told", "bytes")
    return scratch.keep(placed.join(names, "told").select("conv_id", "pos", "tid", "bytes"))


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("len"))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(turns, members (conv_id, len)) when each conversation begins with the first turns of the first of its five.

    How many is told by a checksum of its id; its own turns after as many follow.
    """
    own = scratch.keep(lengths(turns))
    many = F.crc32(F.col("conv_id").cast("string")) % HEAD
    place = F.pmod("conv_id", F.lit(FAMILY))
    first = F.col("conv_id") - place
    base = own.where(place == 0).select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    members = own.select("conv_id", "len", many.alias("h"), first.alias("base")).join(base, "base", "left")
    head = F.least("h", F.coalesce("base_len", F.lit(0))).alias("head")
    members = scratch.keep(members.select("conv_id", "base", "h", head, F.greatest(F.col("len") - F.col("h"), F.lit(0)).alias("rest")))
    heads = turns.where((F.col("pos") < HEAD - 1) & (place == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(members, "base").where("pos < h").select("conv_id", "pos", "tid", "bytes")
    rests = turns.join(members.where("rest > 0"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "tid", "bytes")
    return heads.unionByName(rests), members.select("conv_id", (F.col("head") + F.col("rest")).alias("len"))


def trie(turns: DataFrame, members: DataFrame, scratch: Scratch, local: int | None = None) -> DataFrame:
    """Nodes of ``turns`` (conv_id, pos, tid, bytes) of ``members`` (conv_id, len), turnless ones included."""
    local = LOCAL if local is None else local
    spark = turns.sparkSession
    held = F.sort_array(F.collect_list(F.struct("pos", "tid", "bytes")))
    segments = turns.groupBy("conv_id", F.expr(f"pos div {SEGMENT}").alias("seg")).agg(held.alias("x"))
    segments = scratch.keep(segments.select("conv_id", "seg", F.col("x.tid").alias("ids"), F.col("x.bytes").alias("sizes")))
    members = scratch.keep(members)
    least, n = members.agg(F.min("conv_id"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], NODE)
    here = members.select(F.lit(least).alias("b"), F.lit(0).cast("long").alias("d"), "conv_id", "len")
    meta = spark.createDataFrame([(least, 0, None, 0, n)], "b long, d long, parent long, bytes long, n long")
    rounds, alone, small, weight = [], [], [], 0
    while here is not None:
        stretch, kids, moved, ends = _dealt(here, meta, segments, scratch, local)
        rounds.append((stretch, kids, ends))
        alone.append(moved.where("kind = 'one'").select("conv_id", "depth", "b", "len"))
        small.append(moved.where("kind = 'small'").select("c", "depth", "b", "d", "conv_id"))
        left = kids.agg(F.count_if(F.col("kind") == "open"), F.sum(F.when(F.col("kind") == "small", F.col("weight")))).first()
        weight += left[1] or 0
        here = moved.where("kind = 'open'").select(F.col("c").alias("b"), F.col("depth").alias("d"), "conv_id", "len") if left[0] else None
        meta = kids.where("kind = 'open'").select(F.col("c").alias("b"), F.col("depth").alias("d"), F.col("b").alias("parent"), "bytes", "n")
    finished = scratch.keep(_finished(reduce(DataFrame.unionByName, small), segments, weight // local + 1))
    tops = finished.where("top_b is not null").groupBy(F.col("top_b").alias("b"), F.col("top_d").alias("d"))
    tops = scratch.keep(tops.agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
    out, below = [finished.select(COLUMNS), *map(_chains, alone)], None
    for stretch, kids, ends in reversed(rounds):
        nodes = scratch.keep(_summed(stretch, kids, ends, tops, below))
        below = nodes.where("depth = d").select("b", "d", "n_leaves", "saved_tokens")
        out.append(nodes.select(COLUMNS))
    return reduce(DataFrame.unionByName, out)


def _dealt(here: DataFrame, meta: DataFrame, segments: DataFrame, scratch: Scratch, local: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round: (stretches, children, members by child, members that end), from (b, d, conv_id, len) of open buckets."""
    none = F.array().cast("array<bigint>")
    rest = lambda c: F.coalesce(F.slice(c, (F.col("d") % SEGMENT + 1).cast("int"), F.lit(SEGMENT)), none).alias(c)
    rows = here.withColumn("seg", F.expr(f"d div {SEGMENT}")).join(segments, ["conv_id", "seg"], "left")
    rows = scratch.keep(rows.select("b", "d", "conv_id", "len", rest("ids"), rest("sizes")))
    first = rows.where("conv_id = b").select("b", "d", F.col("ids").alias("shared"), F.col("sizes").alias("chain"))
    same = F.zip_with("ids", "shared", lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    common = rows.join(first, ["b", "d"]).select("b", "d", F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int").alias("n"))
    common = common.groupBy("b", "d").agg(F.min("n").alias("skip"))
    carry = ((F.col("skip") > 0) & ((F.col("d") + F.col("skip")) % SEGMENT == 0)).alias("carry")
    stretch = scratch.keep(common.join(first, ["b", "d"]).join(meta, ["b", "d"]).select("b", "d", "skip", carry, F.slice("chain", 1, F.col("skip")).alias("chain"), "parent", "bytes", "n"))

    dealt = rows.join(stretch.select("b", "d", "skip", "carry"), ["b", "d"])
    step = F.when(F.col("carry"), F.col("skip")).otherwise(F.col("skip") + 1)
    digit = F.when(F.col("carry"), F.lit(-1).cast("long")).otherwise(F.get("ids", F.col("skip")))
    dealt = dealt.select("b", "d", "conv_id", "len", digit.alias("digit"), (F.col("d") + step).alias("depth"), F.get("sizes", step - 1).alias("bytes"))
    some = dealt.where("digit is not null")
    weight = F.sum(1 + F.col("len") - F.col("depth"))
    kids = some.groupBy("b", "d", "digit", "depth").agg(F.min("conv_id").alias("c"), F.count("*").alias("n"), weight.alias("weight"), F.max("bytes").alias("bytes"))
    kind = F.when(F.col("n") == 1, "one").when(F.col("weight") <= local, "small").otherwise("open")
    kids = scratch.keep(kids.withColumn("kind", kind))
    moved = scratch.keep(some.select("b", "d", "digit", "conv_id", "len").join(kids.select("b", "d", "digit", "depth", "c", "kind"), ["b", "d", "digit"]))
    ends = scratch.keep(_digested(dealt.where("digit is null").select("b", "d", "conv_id")))
    scratch.drop(rows)
    return stretch, kids, moved, ends


def _digested(ends: DataFrame) -> DataFrame:
    """(b, d, ends_sha256) of each bucket's members that end; parts of at most ``PART`` ids are joined first."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = ends.groupBy("b", "d", F.shiftright("conv_id", PART_BITS).alias("q")).agg(ids.alias("ids"))
    return parts.repartition("b", "d").sortWithinPartitions("b", "d", "q").mapInArrow(_digest_pass, "b long, d long, ends_sha256 string")


def _digest_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha, done = None, None, []
    for batch in batches:
        for b, d, ids in zip(*[batch.column(c).to_pylist() for c in ("b", "d", "ids")], strict=True):
            if (b, d) == key:
                sha.update(b",")
            else:
                if sha is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = (b, d), hashlib.sha256()
            sha.update(ids.encode())
    if sha is not None:
        done.append((*key, sha.hexdigest()))
    columns = list(zip(*done, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["b", "d", "ends_sha256"])


def _chains(alone: DataFrame) -> DataFrame:
    """The nodes of conversations that share no more: one after another to the last turn."""
    many = F.explode(F.sequence(F.col("depth"), F.col("len"), F.lit(PART).cast("long")))
    rows = alone.withColumn("from", many)
    rows = rows.withColumn("at", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PART - 1, F.col("len")))))
    one, last = F.lit(1).cast("long"), F.col("at") == F.col("len")
    digest = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING)
    return rows.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("b")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), digest.alias("ends_sha256"),
    )


def _summed(stretch: DataFrame, kids: DataFrame, ends: DataFrame, tops: DataFrame, below: DataFrame | None) -> DataFrame:
    """A round's nodes, with what its children add: (b, d, and a node's columns)."""
    zero = F.lit(0).cast("long")
    alone = kids.where("kind = 'one'").groupBy("b", "d").agg(F.count("*").alias("kids"), F.count("*").alias("leaves"), zero.alias("saved"))
    parts = [alone, tops.join(stretch.select("b", "d"), ["b", "d"], "left_semi").select("b", "d", "kids", "leaves", "saved")]
    if below is not None:
        known = below.select(F.col("b").alias("c"), F.col("d").alias("depth"), "n_leaves", "saved_tokens")
        parts.append(kids.where("kind = 'open'").join(known, ["c", "depth"]).groupBy("b", "d").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("b", "d").agg(F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    rows = stretch.join(sums, ["b", "d"], "left").join(ends, ["b", "d"], "left")
    # the last node of a stretch that is carried on opens the next one
    sizes = F.concat(F.array("bytes"), F.when(F.col("carry"), F.slice("chain", 1, F.size("chain") - 1)).otherwise(F.col("chain")))
    rows = rows.withColumn("sizes", sizes).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("sizes") - 1)))
    last = F.col("i") == F.size("sizes") - 1
    behind = F.aggregate(F.slice("sizes", F.col("i") + 1, F.size("sizes")), zero, lambda a, x: a + x)
    return rows.select(
        "b", "d", F.col("b").alias("conv_id"), (F.col("d") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("b")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.coalesce("kids", zero)).otherwise(1).cast("long").alias("n_children"),
        F.when(F.coalesce("kids", zero) == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        (F.coalesce("saved", zero) + (F.col("n") - 1) * behind).alias("saved_tokens"), F.when(last, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
    )


def _finished(small: DataFrame, segments: DataFrame, bins: int) -> DataFrame:
    """The nodes of small buckets, several to a task; top_b and top_d name the bucket above a bucket's first node."""
    rows = small.join(segments, "conv_id").where(f"(seg + 1) * {SEGMENT} >= depth").withColumn("bin", F.pmod(F.xxhash64("c", "depth"), F.lit(bins)))
    return rows.groupBy("bin").applyInArrow(_sort_pass(SEGMENT), f"{NODE}, top_b long, top_d long")


def _sort_pass(segment: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("c", "ascending"), ("depth", "ascending"), ("conv_id", "ascending"), ("seg", "ascending")])
        conv, c, depth, b, d, seg = (rows.column(x).to_numpy() for x in ("conv_id", "c", "depth", "b", "d", "seg"))
        ids, sizes = (rows.column(x).combine_chunks() for x in ("ids", "sizes"))
        tokens, weights, starts = ids.flatten().tolist(), sizes.flatten().tolist(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        new = np.ones(len(conv), bool)
        new[1:] = (conv[1:] != conv[:-1]) | (c[1:] != c[:-1]) | (depth[1:] != depth[:-1])
        at = np.flatnonzero(new)
        ends = starts[np.append(at[1:], len(conv))]
        # a member's turns from depth - 1 on; zero[m] + t is where turn t stands
        zero = (starts[at] - seg[at] * segment).tolist()
        own, last = conv[at].tolist(), (ends - (starts[at] - seg[at] * segment)).tolist()
        out = Nodes(tokens, weights, zero, last, own)
        bucket = np.ones(len(at), bool)
        bucket[1:] = (c[at][1:] != c[at][:-1]) | (depth[at][1:] != depth[at][:-1])
        cuts = np.flatnonzero(bucket).tolist() + [len(at)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            i = at[x]
            out.bucket(list(range(x, y)), int(depth[i]), int(b[i]), int(d[i]))
        return out.table()

    return run


class Nodes:
    """Multikey quicksort over the members of buckets, emitting the nodes that it meets."""

    def __init__(self, tokens: list[int], weights: list[int], zero: list[int], last: list[int], own: list[int]):
        self.tokens, self.weights, self.zero, self.last, self.own = tokens, weights, zero, last, own
        self.rows: list[list] = []
        self.chains: list[tuple[int, int, int]] = []  # member, first depth, the parent's conversation

    def bucket(self, members: list[int], depth: int, b: int, d: int) -> None:
        first = len(self.rows)
        self._walk(members, depth, b)
        self.rows[first][8:10] = [b, d]
        for i in range(len(self.rows) - 1, first - 1, -1):  # children come after their parents
            row = self.rows[i]
            row[5] = row[5] if row[4] else 1
            up = row.pop()
            if up is not None:
                self.rows[up][5] += row[5]
                self.rows[up][6] += row[6]

    def _walk(self, members: list[int], depth: int, parent: int) -> None:
        todo = [(members, depth, parent, None)]
        while todo:
            some, depth, parent, up = todo.pop()
            here, conv = len(self.rows), self.own[some[0]]
            ended = [m for m in some if self.last[m] == depth]
            parts = self._parted([m for m in some if self.last[m] > depth], depth)
            chains = [p[0] for p in parts if len(p) == 1]
            self.chains += [(m, depth + 1, conv) for m in chains]
            digest = hashlib.sha256(",".join([str(self.own[m]) for m in ended]).encode()).hexdigest() if ended else NOTHING
            saved = (len(some) - 1) * self.weights[self.zero[some[0]] + depth - 1]
            self.rows.append([conv, depth, parent, len(some), len(parts), len(chains), saved, digest, None, None, up])
            todo += [(p, depth + 1, conv, here) for p in parts if len(p) > 1]

    def _parted(self, some: list[int], depth: int) -> list[list[int]]:
        """Members by their turn at ``depth``, each part in the order of ``some``."""
        parts, todo = [], [some] if some else []
        while todo:
            some = todo.pop()
            if len(some) == 1:
                parts.append(some)
                continue
            turns = [self.tokens[self.zero[m] + depth] for m in some]
            pivot = turns[len(turns) // 2]
            parts.append([m for m, t in zip(some, turns, strict=True) if t == pivot])
            for side in ([m for m, t in zip(some, turns, strict=True) if t < pivot], [m for m, t in zip(some, turns, strict=True) if t > pivot]):
                if side:
                    todo.append(side)
        return parts

    def table(self) -> pa.Table:
        member, first, parent = (np.array(x, np.int64) for x in (zip(*self.chains, strict=True) if self.chains else ((), (), ())))
        own, last = np.array(self.own, np.int64), np.array(self.last, np.int64)
        n = last[member] - first + 1
        which = np.repeat(np.arange(len(n)), n)
        depth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]
        conv, end = own[member][which], depth == last[member][which]
        digests = np.full(len(which), NOTHING, object)
        digests[end] = [hashlib.sha256(str(x).encode()).hexdigest() for x in conv[end].tolist()]
        one = np.ones(len(which), np.int64)
        chain = [conv, depth, np.where(depth == first[which], parent[which], conv), one, 1 - end, one, 0 * one, digests, np.full(len(which), None), np.full(len(which), None)]
        rows = list(zip(*self.rows, strict=True)) or [[]] * 10
        types = [pa.int64()] * 7 + [pa.string()] + [pa.int64()] * 2
        both = [pa.chunked_array([pa.array(list(r), t), pa.array(c.tolist(), t)]) for r, c, t in zip(rows, chain, types, strict=True)]
        return pa.Table.from_arrays(both, [*COLUMNS, "top_b", "top_d"])


def build(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie's nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of conversations as they are.

    A node is named by its smallest conversation and its depth, from the root at 0. saved_tokens: bytes that need no second reading
    below the node when what is shared is read once.
    """
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    turns = encoded(conversations, scratch, conv_col, turn_col, role_col, text_col)
    return scratch.finish(trie(turns, lengths(turns), scratch))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations when each begins like the first of its five."""
    scratch = Scratch(spark, "prefix-trie")
    turns = encoded(table(spark, sf_dir, "conversations"), scratch)
    return scratch.finish(trie(*rebuilt(turns, scratch), scratch))


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, b AS v, 0 AS k FROM (SELECT unnest(range(256))::UBIGINT AS b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
ids AS (
  SELECT conv_id, conv_id - (conv_id % 5 + 5) % 5 AS base,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::UBIGINT), lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc
),
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, told) - 1 AS pos, told, bytes
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS told, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)
),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth, told, bytes
  FROM (
    SELECT ids.conv_id, 0 AS side, pos, told, bytes FROM ids JOIN own ON own.conv_id = ids.base AND pos < h
    UNION ALL SELECT ids.conv_id, 1, pos, told, bytes FROM ids JOIN own ON own.conv_id = ids.conv_id AND pos >= h
  )
),
paths AS (
  SELECT conv_id, 0 AS depth, '' AS p, 0 AS bytes FROM ids
  UNION ALL SELECT conv_id, depth, string_agg(told, '') OVER (PARTITION BY conv_id ORDER BY depth), bytes FROM turns
),
nodes AS (
  SELECT p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths) GROUP BY p
),
kids AS (SELECT substr(p, 1, 64 * (depth - 1)) AS up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
below AS (
  SELECT substr(p, 1, 64 * i) AS top, count(*) FILTER (WHERE n IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT p, n_convs, bytes, kids.n, unnest(range(depth + 1)) AS i FROM nodes LEFT JOIN kids ON up = p) GROUP BY top
)
SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes up ON x.depth > 0 AND up.p = substr(x.p, 1, 64 * (x.depth - 1)) LEFT JOIN kids ON kids.up = x.p JOIN below ON top = x.p
"""

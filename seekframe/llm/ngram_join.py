"""N-gram Jaccard join: documents whose sets of word 5-grams have a similarity of 0.75 or more.

Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``; a text's set holds its distinct 5-grams, or its whole
sequence of words when that's shorter; without words it is empty and links with nothing. Sets are compared as
64-bit hashes of their n-grams, in which every step is mixed anew. Texts with equal sets are one class, by a 128-bit digest and the size.

1. *Sieve.* Similar sets share at least 0.75 of the larger one's n-grams, so of the least (by hash) quarter of a set
   and the next ``EXTRA`` some must be found in another class. Blocks of texts send these n-grams, packed, to the
   bucket of their hash; one that occurs in several of the block's texts is sent once for all of them, so n-grams
   that a third of all texts have cost one entry a block. Classes with too few shared ones link with nothing.
2. *Order.* The rest's n-grams get one order: rarest first, then by hash. Similar sets share an n-gram in their first
   quarter in that order. Connecting sets by those n-grams, each n-gram's sets to the least of them, gives neighbourhoods;
   links never leave one.
3. *Prefix tree.* A neighbourhood of at most ``MEMBERS`` sets and ``GRAMS`` n-grams is one group, larger ones are dealt
   into several. A group stores its sets, most frequent n-gram first, in a prefix tree. Each set walks the tree once, a level at a time: the
   overlap with a branch is summed once for all sets below; a subtree is left when the overlap so far and the
   remaining lengths cannot reach the threshold, or when all its sets are connected to the walking one already. A group
   returns a tree that spans its links, never pairs.
4. *Between the groups* of a neighbourhood that was dealt out, each n-gram's sets in different components are compared: first
   the least set of each component with the least of all, round by round while that links any; then what is still
   apart meets in trees again, whose walks leave what is connected: the sets of one n-gram are a group, those of rare ones
   together in one, those of one that more than ``MEMBERS`` sets have, or sets of more than ``GRAMS`` n-grams, dealt into tiles, each pair of which is a group.

Every row gets the size of its set and the smallest id that links reach from its text. Rows with a null id have no
component and link nothing. Rows that repeat an id are judged each by its own text. Only the id and the
text are read. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm.components import components
from seekframe.llm.scratch import Scratch
from seekframe.llm.words import Hasher, Piece, mix, pieces, trim
from seekframe.tables import table

SIZE = 5
EXTRA = 0.15
MEMBERS, GRAMS = 16_384, 2_000_000
#: Sieved n-grams that a bucket holds on average, at most; and the fewest buckets.
BUCKET, BUCKETS = 500_000, 64
#: Sieved n-grams that a block of texts gathers before it sends any: what is common is sent once a block.
BLOCK = 1 << 20
ROUNDS = 3
#: Tokens of the tree that a walk looks up at once.
WALK = 1 << 20


def similar(both: np.ndarray, one: int, other: np.ndarray) -> np.ndarray:
    """100 * intersection >= 75 * union."""
    return 7 * both >= 3 * (one + other)


class Shingles:
    """Sets of n-gram hashes of a piece's texts."""

    def __init__(self, size: int = SIZE):
        self.size, self.hasher = size, Hasher(31)

    def sets(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, n + 1 bounds): each text's distinct hashes, ascending."""
        words = self.hasher.of_bytes(piece.data, piece.starts, piece.ends)
        counts = np.diff(piece.words)
        grams = np.where(counts >= self.size, counts - self.size + 1, np.minimum(counts, 1))
        text = np.repeat(np.arange(len(counts)), grams)
        first = np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(piece.words[:-1], grams)
        length = np.minimum(counts, self.size)[text]
        hashes = np.zeros(len(text), np.uint64)
        for size in np.unique(length).tolist():  # shorter ones are whole texts
            of = np.flatnonzero(length == size)
            hashes[of] = self.hasher.runs(words, size)[first[of]]
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        hashes, text = hashes[new], text[new]
        return hashes, np.searchsorted(text, np.arange(len(counts) + 1))

    @staticmethod
    def digests(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        out = []
        for salt in (0x1234567, 0x89ABCDEF):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
            out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
        return out


def _sets_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        told = [c for c in batch.schema.names if c != "text"]
        for piece in pieces(batch.column("text"), lower=True):
            hashes, bounds = shingles.sets(piece)
            d1, d2 = shingles.digests(hashes, bounds)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(piece.first, len(piece)) for c in told], pa.array(np.diff(bounds)), pa.array(d1), pa.array(d2)], [*told, "n", "d1", "d2"])


def _region(n: np.ndarray) -> np.ndarray:
    """How many of a set's least hashes the sieve looks at."""
    return np.minimum(n, n // 4 + np.maximum(1, (n * EXTRA).astype(np.int64)))


def least_shared(n: int) -> int:
    """How many of those another class must have."""
    return max(1, int(-(-3 * n // 4) * EXTRA))


def _sieve_pass(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for piece in pieces(batch.column("text"), lower=True):
                hashes, bounds = shingles.sets(piece)
                d1, _ = shingles.digests(hashes, bounds)
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                kept = np.arange(len(hashes)) - np.repeat(bounds[:-1], n) < np.repeat(_region(n), n)
                held.append((hashes[kept], d1[text[kept]]))
                if sum(len(h) for h, _ in held) >= BLOCK:
                    yield from _sieved(held, buckets)
                    held = []
        if held:
            yield from _sieved(held, buckets)
        trim()

    return run


def _sieved(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's n-grams, each once: with its class, or 0 where the block has it in several, which it then counts itself."""
    grams, classes = np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held])
    held.clear()
    order = np.lexsort((classes, grams))
    grams, classes = grams[order], classes[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    other = new.copy()
    other[1:] |= classes[1:] != classes[:-1]  # copies in a block count once
    grams, classes, new = grams[other], classes[other], new[other]
    several = ~new
    several[:-1] |= ~new[1:]
    own, counted = np.unique(classes[several], return_counts=True)
    # what the block has counted itself goes to any bucket, which passes it on
    yield _sieve_rows(own % buckets, [b""] * len(own), [b""] * len(own), own, counted)
    grams, classes = grams[new], np.where(several[new], 0, classes[new])
    bucket = ((grams & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    grams, classes, bucket = grams[order] >> np.uint64(24), classes[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
    for at in range(0, len(cuts) - 1, 4096):
        part = cuts[at : at + 4097]
        packed = [[x[a:b].tobytes() for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)] for x in (grams, classes)]
        none = np.zeros(len(part) - 1, np.int64)
        yield _sieve_rows(bucket[part[:-1]], *packed, none, none)


def _sieve_rows(bucket: np.ndarray, grams: list[bytes], classes: list[bytes], d1: np.ndarray, counted: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(grams, pa.binary()), pa.array(classes, pa.binary()), pa.array(d1), pa.array(counted.astype(np.int64))], ["bucket", "grams", "classes", "d1", "counted"])


def _shared(rows: pa.Table) -> pa.Table:
    """How many of each class's n-grams in a bucket other classes have. Class 0 stands for several of one block.

    Rows that blocks have counted themselves are added.
    """
    ready = rows.filter(pc.greater(rows.column("counted"), 0))
    grams = np.frombuffer(b"".join(rows.column("grams").to_pylist()), np.uint64)
    classes = np.frombuffer(b"".join(rows.column("classes").to_pylist()), np.int64)
    order = np.argsort(grams, kind="stable")
    grams, classes = grams[order], classes[order]
    first = np.flatnonzero(np.diff(grams, prepend=grams[0] + np.uint64(1))) if len(grams) else np.zeros(0, np.int64)
    if len(first):
        shared = (np.minimum.reduceat(classes, first) != np.maximum.reduceat(classes, first))
        shared = np.repeat(shared, np.diff(np.append(first, len(grams))))
        shared &= classes != 0
        of, counts = np.unique(classes[shared], return_counts=True)
    else:
        of = counts = np.zeros(0, np.int64)
    of = np.concatenate([of.astype(np.int64), ready.column("d1").to_numpy()])
    counts = np.concatenate([counts.astype(np.int64), ready.column("counted").to_numpy()])
    of, place = np.unique(of, return_inverse=True)
    return pa.table([pa.array(of), pa.array(np.bincount(place, weights=counts, minlength=len(of)).astype(np.int64))], ["d1", "counted"])


def _members_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of candidates' texts; a text of the candidate's id that isn't of its class is left."""
    shingles = Shingles()
    for batch in batches:
        of = batch.column("of")
        for piece in pieces(batch.column("text"), lower=True):
            hashes, bounds = shingles.sets(piece)
            d1, d2 = shingles.digests(hashes, bounds)
            part = slice(piece.first, piece.first + len(piece))
            same = np.logical_and.reduce([of.field(i).to_numpy()[part] == x for i, x in enumerate((d1, d2, np.diff(bounds)))])
            grams = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            rows = pa.RecordBatch.from_arrays([batch.column("key").slice(piece.first, len(piece)), batch.column("id").slice(piece.first, len(piece)), pa.array(np.diff(bounds)), grams], ["key", "node", "n", "grams"])
            yield rows.filter(pa.array(same))


class PrefixTree:
    """Sets of token ranks, each ascending, with shared beginnings stored once.

    A place is a set's number in the order of the sets. Nodes are columns, by number: the places ``lo`` to ``hi`` below, the depths
    ``before`` and ``after`` its tokens, where those lie in ``flat``, the first and last of them, the ``least`` and ``most`` tokens of
    a set below, and how many sets ``ends`` there. Children are numbered one after the other.
    """

    def __init__(self, sets: list[np.ndarray], tokens: int, parts: np.ndarray | None = None):
        """``parts``: what each set is connected to already; sets of one part aren't compared."""
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.root = np.arange(len(sets))  # by place
        if parts is not None and len(sets):
            _, first, of = np.unique(parts[self.order], return_index=True, return_inverse=True)
            self.root = first[of]
        self.mark = np.zeros(tokens, bool)
        self._build()

    def _build(self) -> None:
        sets = self.sets
        size = np.array([len(s) for s in sets], np.int64)
        starts = np.cumsum(size) - size
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
        rows: list[tuple] = []
        waiting = [(0, len(sets), 0)] if sets else []  # level by level, so that children lie together
        numbered = len(waiting)
        for lo, hi, depth in waiting:
            one, other = sets[lo], sets[hi - 1]
            short = min(len(one), len(other))
            differ = np.flatnonzero(one[depth:short] != other[depth:short])
            end = depth + int(differ[0]) if len(differ) else short
            own = size[lo:hi]
            at = lo
            while at < hi and size[at] == end:
                at += 1
            ends = at - lo
            while at < hi:
                token, low, high = sets[at][end], at, hi
                while low < high:
                    mid = (low + high) // 2
                    if sets[mid][end] <= token:
                        low = mid + 1
                    else:
                        high = mid
                waiting.append((at, low, end))
                at = low
            edge = (int(one[depth]), int(one[end - 1])) if end > depth else (0, -1)
            rows.append((lo, hi, depth, end, starts[lo] + depth, *edge, own.min(), own.max(), ends, numbered, len(waiting)))
            numbered = len(waiting)
        columns = np.array(rows, np.int64).reshape(-1, 12).T
        self.lo, self.hi, self.before, self.after, self.start, self.first, self.last, self.least, self.most, self.ends, self.child, self.child_end = columns

    def connect(self) -> np.ndarray:
        """The least place connected with each place, by links of similar sets."""
        stale = True
        for x in range(len(self.sets)):
            if stale:
                changes = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])
                self.one = changes[self.lo] == changes[self.hi - 1]  # nodes whose sets are all connected; they stay so
            stale = self._walk(x)
        return self.root

    def _walk(self, x: int) -> bool:
        """Link a set with later ones, a level of the tree at a time; whether that connected anything new."""
        own = self.sets[x].astype(np.int64)
        n = len(own)
        self.mark[own] = True
        linked = [np.zeros(0, np.int64)]
        nodes = overlap = np.zeros(1, np.int64)  # the overlap is that with the way to the nodes
        while len(nodes):
            stay = (self.hi[nodes] - 1 > x) & ~(self.one[nodes] & (self.root[self.lo[nodes]] == self.root[x]))
            nodes, overlap = nodes[stay], overlap[stay]
            stay = self._reach(nodes, overlap, self.before[nodes], n - np.searchsorted(own, self.first[nodes]), n)
            nodes, overlap = nodes[stay], overlap[stay]
            overlap = overlap + self._marked(nodes)
            stay = self._reach(nodes, overlap, self.after[nodes], n - np.searchsorted(own, self.last[nodes], "right"), n)
            nodes, overlap = nodes[stay], overlap[stay]
            close = nodes[similar(overlap, n, self.after[nodes])]
            linked.append(_ranges(self.lo[close], self.ends[close]))
            width = self.child_end[nodes] - self.child[nodes]
            nodes, overlap = _ranges(self.child[nodes], width), np.repeat(overlap, width)
        self.mark[own] = False
        places = np.concatenate(linked)
        roots = np.unique(self.root[np.append(places[places > x], x)])
        moved = np.zeros(len(self.root), bool)
        moved[roots[1:]] = True
        if len(roots) > 1:
            self.root[moved[self.root]] = roots[0]
        return len(roots) > 1

    def _reach(self, nodes: np.ndarray, overlap: np.ndarray, depth: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
        """Whether a set below, of the best size there is, can be similar if it has all of the ``left`` tokens after a depth."""
        best = np.minimum(np.maximum(depth + left, self.least[nodes]), self.most[nodes])
        return similar(overlap + np.minimum(left, best - depth), n, best)

    def _marked(self, nodes: np.ndarray) -> np.ndarray:
        """How many of each node's tokens the walking set has."""
        sizes = self.after[nodes] - self.before[nodes]
        ends = np.cumsum(sizes)
        found, at = [np.zeros(0, np.int64)], 0
        while at < len(nodes):
            done = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, done + WALK, "right")))
            hits = np.concatenate([[0], np.cumsum(self.mark[self.flat[_ranges(self.start[nodes[at:to]], sizes[at:to])]])])
            found.append(hits[ends[at:to] - done] - hits[ends[at:to] - sizes[at:to] - done])
            at = to
        return np.concatenate(found)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one range after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _tree_pass(rows: pa.Table) -> pa.Table:
    """(key, node, part): each set of a group with the least key it is connected to."""
    rows = rows.combine_chunks()
    grams = rows.column("grams").combine_chunks()
    flat = grams.flatten().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(grams).to_numpy(zero_copy_only=False), dtype=np.int64)])
    known, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.uint32)
    rank[np.lexsort((known, -count))] = np.arange(len(known), dtype=np.uint32)
    ranks = rank[place]
    sets = [np.sort(ranks[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    tree = PrefixTree(sets, len(known), rows.column("part").to_numpy() if "part" in rows.column_names else None)
    root = tree.connect()
    keys = rows.column("key").to_numpy()
    order = np.array(tree.order, np.int64)
    part = np.empty(len(keys), np.int64)
    for r in np.unique(root):
        own = order[root == r]
        part[own] = keys[own].min()
    return pa.table([rows.column("key"), pa.array(part)], ["key", "part"])


def _linked_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar."""
    of = lambda name: members.select(F.col("key").alias(name), F.col("grams").alias(f"{name}_grams"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    return both.where(7 * shared >= 3 * (F.size("a_grams") + F.size("b_grams"))).select("a", "b")


def _relabelled(parts: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``parts`` (key, part) after joining the parts of the edges' ends."""
    part = lambda name: parts.select(F.col("key").alias(name), F.col("part").alias(f"p{name}"))
    joined = edges.join(part("a"), "a").join(part("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    merged = components(joined, scratch).select(F.col("node").alias("part"), "component")
    return scratch.keep(parts.join(merged, "part", "left").select("key", F.coalesce("component", "part").alias("part")))


def _between(parts: DataFrame, prefix: DataFrame, members: DataFrame, scratch: Scratch, most: int, grams_most: int) -> DataFrame:
    """``parts`` with the links between groups. ``prefix``: (gram, key, n) of the sets in dealt-out neighbourhoods."""
    apart = lambda parts: _apart(prefix.join(parts, "key"), scratch)
    for _ in range(ROUNDS):
        rows = apart(parts)
        first = rows.groupBy("gram", "part").agg(F.min("key").alias("b"))
        least = first.groupBy("gram").agg(F.min("b").alias("a"))
        pairs = first.join(least, "gram").where("a <> b").select("a", "b").distinct()
        found = scratch.keep(_linked_pairs(pairs, members))
        if found.isEmpty():
            break
        parts = _relabelled(parts, found, scratch)
    rows = apart(parts).select("gram", "key", "n")
    if rows.isEmpty():
        return parts
    parted = lambda: F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / grams_most)).cast("int")  # noqa: E731  by sets and by their n-grams
    counts = scratch.keep(rows.groupBy("gram").agg(parted().alias("tiles")))
    buckets = rows.agg(parted().alias("n")).first()["n"]
    none = F.lit(-1).alias
    small = rows.join(counts.where("tiles = 1"), "gram").select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("g"), none("x"), none("y"), "key").distinct()
    deal = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    large = rows.join(counts.where("tiles > 1"), "gram").select("gram", "key", deal.alias("t"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    large = large.select(F.col("gram").alias("g"), F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), "key")
    groups = small.unionByName(large).join(parts, "key").join(members.select("key", "grams"), "key")
    found = groups.groupBy("g", "x", "y").applyInArrow(_tree_pass, "key long, part long")
    return _relabelled(parts, scratch.keep(found.select(F.col("key").alias("a"), F.col("part").alias("b"))), scratch)


def _apart(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of n-grams whose sets are in several parts."""
    spread = scratch.keep(rows.groupBy("gram").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("gram"))
    return scratch.keep(rows.join(spread, "gram", "left_semi"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members_most: int = MEMBERS, grams_most: int = GRAMS, mark_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for every row, and ``mark_col``, a string that tells rows of one id apart, if named."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    told = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.col(mark_col).cast("string").alias("mark")] if mark_col else []))
    rows = scratch.keep(told.mapInArrow(_sets_pass, f"id long, {'mark string, ' if mark_col else ''}n long, d1 long, d2 long"))
    classes = scratch.keep(rows.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("node")))

    grams = (rows.agg(F.sum("n").alias("n")).first()["n"] or 0) * (0.25 + EXTRA)
    buckets = max(BUCKETS, int(-(-grams // BUCKET)))
    sieved = source.where("id is not null").mapInArrow(_sieve_pass(buckets), "bucket long, grams binary, classes binary, d1 long, counted long")
    told = sieved.groupBy("bucket").applyInArrow(_shared, "d1 long, counted long").groupBy("d1").agg(F.sum("counted").alias("counted"))
    enough = F.greatest(F.lit(1), F.floor(F.ceil(3 * F.col("n") / 4) * EXTRA).cast("long"))
    left = classes.join(told, "d1").where(F.col("counted") >= enough).select("d1", "d2", "n", "node")
    left = scratch.keep(left.withColumn("key", F.monotonically_increasing_id()))

    # ids of candidates have no bound on their number: never broadcast, the same plan at every size
    wanted = left.select(F.col("node").alias("id"), "key", F.struct("d1", "d2", "n").alias("of")).hint("merge")
    members = scratch.keep(source.join(wanted, "id").mapInArrow(_members_pass, "key long, node long, n long, grams array<long>"))

    each = members.select("key", F.explode("grams").alias("gram"))
    several = scratch.keep(each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"))
    shared = each.join(several, "gram").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g")).join(left.select("key", "n"), "key")
    head = F.floor(F.col("n") / 4).cast("int") + 1 - (F.col("n").cast("int") - F.size("g"))
    prefix = scratch.keep(shared.where(head > 0).select("key", "n", F.explode(F.slice("g", F.lit(1), head)["gram"]).alias("gram")))
    scratch.drop(several)

    stars = prefix.groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("gram", "low")
    near = components(prefix.join(stars, "gram").select(F.col("key").alias("a"), F.col("low").alias("b")), scratch)
    near = scratch.keep(near.select(F.col("node").alias("key"), F.col("component").alias("near")))
    sized = left.select("key", "n").join(near, "key").groupBy("near").agg(F.count("*").alias("c"), F.sum("n").alias("g"))
    sized = scratch.keep(sized.select("near", F.greatest(F.ceil(F.col("c") / members_most), F.ceil(F.col("g") / grams_most)).cast("int").alias("deals")))
    deals = near.join(sized, "near").select("key", "near", F.pmod(F.xxhash64("key"), F.col("deals")).alias("deal"))
    dealt = members.join(deals, "key")
    parts = scratch.keep(dealt.select("near", "deal", "key", "grams").groupBy("near", "deal").applyInArrow(_tree_pass, "key long, part long"))
    if not sized.where("deals > 1").isEmpty():
        large = near.join(sized.where("deals > 1"), "near", "left_semi").select("key")
        parts = _between(parts, prefix.join(large, "key", "left_semi"), members, scratch, members_most, grams_most)

    named = parts.distinct().join(left, "key")
    component = named.groupBy("part").agg(F.min("node").alias("component"))
    by_class = named.join(component, "part").select("d1", "d2", "n", "component")
    classed = classes.join(by_class, ["d1", "d2", "n"], "left").select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    out = rows.join(classed, ["d1", "d2", "n"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return scratch.finish(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), *([F.col("mark").alias(mark_col)] if mark_col else [])))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component of near copies."""
    return join(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_of JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes ON w.doc_id = sizes.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON w.doc_id = r.a
"""

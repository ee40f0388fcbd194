"""Exact vector search over stored lists: the nearest lists first, then those that can still hold something nearer.

Vectors lie in the list of the centroid that their direction is nearest to. A direction's distance to any member of a list is at least
its distance to the centroid less the list's radius, the greatest distance of a member. So once a query has its k-th best
score from the lists next to it, every list whose bound lies beyond is left unread, and nothing is lost. Centroids are fitted on at most ``SAMPLE``
vectors and decide only how much is read; vectors that come later join the lists that there are, whose radii follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.kept import keep
from seekframe.operators import semantic

SAMPLE, LISTS_MOST, ROUNDS = 8192, 1024, 8
#: Vectors next to a query that are read at once: fewer cost less than a second look.
FIRST = 50_000
#: What rounding may change in a bound; scores are compared to 9 digits.
SLACK = 4e-9
CENTROIDS = "list int, centroid array<double>"


def centroids(vectors: DataFrame, lists: int | None = None) -> DataFrame:
    """(list, centroid) for vectors (id, v), about as many as the square root of their number; each length of vector has its own."""
    spark = vectors.sparkSession
    rows = vectors.where(semantic.valid(F.col("v"))).select(F.size("v").alias("dims"), "v")
    counts = {r["dims"]: r["n"] for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # at most 1024 lengths
    total = sum(counts.values())
    some = rows.sample(min(1.0, 1.2 * SAMPLE / max(1, total)), 7).limit(SAMPLE).collect()
    found = []
    for dims, n in sorted(counts.items()):
        own = np.array([r["v"] for r in some if r["dims"] == dims], float).reshape(-1, dims)
        if not len(own):  # a rare length: one list around any direction
            own = np.eye(1, dims)
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        k = min(lists or int(n**0.5), len(own), max(1, LISTS_MOST * n // max(1, total)))
        middle = own[np.random.default_rng(5).permutation(len(own))[: max(1, k)]]
        for _ in range(ROUNDS):
            near = np.argmax(own @ middle.T, axis=1)
            sums = np.zeros_like(middle)
            np.add.at(sums, near, own)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            middle = np.where(size > 0, sums / np.where(size > 0, size, 1), middle)
        found += middle.tolist()
    return spark.createDataFrame([(i, c) for i, c in enumerate(found)], CENTROIDS).coalesce(1)


def _held(middles: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector, lists and centroids: at most ``LISTS_MOST`` and one more a length."""
    by: dict[int, list] = {}
    for r in middles.collect():
        by.setdefault(len(r["centroid"]), []).append((r["list"], r["centroid"]))
    return {dims: (np.array([x for x, _ in rows]), np.array([c for _, c in rows], float)) for dims, rows in by.items()}


def assigned(vectors: DataFrame, middles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, list, gap, v): valid vectors with their list and their direction's distance to its centroid, as doubles."""
    held, kind = _held(middles), vectors.schema[id_col].dataType.simpleString()
    rows = vectors.where(semantic.valid(F.col("v"))).select(id_col, F.col("v").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            dims = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            lists, gaps = np.full(len(dims), -1), np.full(len(dims), 2.0)
            for d in np.unique(dims):
                if d not in held:  # a length that no centroid has: a list of its own, read by every query of that length
                    lists[dims == d] = -int(d)
                    continue
                names, middle = held[d]
                at = np.flatnonzero(dims == d)
                own = flat[starts[at][:, None] + np.arange(d)]
                own = own / np.linalg.norm(own, axis=1, keepdims=True)
                near = own @ middle.T
                best = np.argmax(near, axis=1)
                lists[at] = names[best]
                gaps[at] = np.linalg.norm(own - middle[best], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.int32()), pa.array(gaps, pa.float64()), v], [id_col, "list", "gap", "v"])

    return rows.mapInArrow(run, f"{id_col} {kind}, list int, gap double, v array<double>")


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` as they are best written: a list's vectors together, so that its rows are read and few others."""
    return rows.repartitionByRange("list").sortWithinPartitions("list")


def nearest(rows: DataFrame, middles: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank), as semantic.nearest() gives them. ``rows``: of assigned()."""
    kind, told = queries.schema["query_id"].dataType.simpleString(), (_held(middles), _spans(rows))
    some = queries.limit(semantic.QUERIES_MOST + 1).collect()
    if len(some) <= semantic.QUERIES_MOST:
        return _searched(rows, *told, some, limit, kind)[0]
    blocks = -(-queries.count() // semantic.QUERIES_MOST) + 1
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = (dealt.where(F.col("block") == n).drop("block").collect() for n in range(blocks))
    return reduce(DataFrame.unionByName, [_searched(rows, *told, part, limit, kind)[0] for part in parts])


Pairs = list[tuple[int, int]]
Spans = dict[int, tuple[float, int]]


def _spans(rows: DataFrame) -> Spans:
    """Radius and size of each list."""
    return {r["list"]: (r["radius"], r["n"]) for r in rows.groupBy("list").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()}


def _nearest(rows: DataFrame, middles: DataFrame, queries: list, limit: int, kind: str = "int") -> tuple[DataFrame, Pairs, Pairs]:
    """(the result, (query, list) of the lists read first, and of those read after)."""
    out, asked, first, after = _searched(rows, _held(middles), _spans(rows), queries, limit, kind)
    pairs = lambda reads: [(asked.names[q], asked.lists[i]) for q, i in np.argwhere(reads).tolist()]
    return out, pairs(first), pairs(after)


class Asked:
    """Up to ``QUERIES_MOST`` queries by length of vector, and the lists that there are; ``names`` of queries in order."""

    def __init__(self, queries: list, spans: Spans):
        good = {r["query_id"]: [float(x) for x in r["q"]] for r in queries if r["q"] and all(x is not None and np.isfinite(x) for x in r["q"]) and any(r["q"])}
        self.names, self.lists, self.sizes = list(good), sorted(spans), {x: n for x, (_, n) in spans.items()}
        self.place = {name: i for i, name in enumerate(self.lists)}
        by: dict[int, list[int]] = {}
        for at, q in enumerate(good.values()):
            by.setdefault(len(q), []).append(at)
        whole = list(good.values())
        #: By length: places of its queries, and their vectors.
        self.groups = {d: (np.array(at), np.array([whole[i] for i in at], float)) for d, at in by.items()}

    def reach(self, held: dict, spans: Spans, least: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and list whether it's among the next ones that hold ``least`` vectors, and the most that a score in it can be, -1 if none."""
        first = np.zeros((len(self.names), len(self.lists)), bool)
        most = np.full(first.shape, -1.0)
        for d, (places, vectors) in self.groups.items():
            names, middle = held.get(d, (np.zeros(0, int), np.zeros((0, d))))
            some = [j for j, name in enumerate(names.tolist()) if name in spans]
            names, middle = names[some].tolist(), middle[some]
            at = np.array([self.place[x] for x in names], int)
            radius, n = np.array([spans[x][0] for x in names]), np.array([spans[x][1] for x in names], int)
            own = self.place.get(-d)  # vectors whose length has no centroid
            for i, q in zip(places.tolist(), vectors, strict=True):
                gaps = np.linalg.norm(middle - q / np.linalg.norm(q), axis=1)
                low = np.maximum(0.0, gaps - radius)
                order = np.lexsort((at, gaps, low))
                before = np.cumsum(n[order]) - n[order]
                most[i, at] = 1 - low * low / 4
                first[i, at[order[before < least]]] = True
                if own is not None:
                    most[i, own] = 1.0
                    first[i, own] = int(n.sum()) < least
        return first, most


def _searched(rows: DataFrame, held: dict, spans: Spans, queries: list, limit: int, kind: str) -> tuple[DataFrame, Asked, np.ndarray, np.ndarray]:
    """(the result, its queries, for each query and list whether it's read first, and whether after)."""
    asked = Asked(queries, spans)
    first, most = asked.reach(held, spans, max(2 * limit, FIRST))
    begun = _best(_scored(rows, asked, first, limit, kind), limit)
    rest = ~first & (most >= 0)
    if not rest.any():
        return begun, asked, first, rest
    begun = keep(begun.drop("rank"), "nearest")
    found = begun.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).collect()  # a row a query
    least = {r["query_id"]: r["kth"] - SLACK for r in found if r["n"] >= limit}
    rest &= most >= np.array([least.get(name, 0.0) for name in asked.names])[:, None]
    out = _best(begun.unionByName(_scored(rows, asked, rest, limit, kind)) if rest.any() else begun, limit)
    return out, asked, first, rest


#: Vectors compared with all queries at once, and pairs of them whose scores are resolved at once.
TILE, PAIRS = 1024, 65_536
#: Bytes a core below which the vectors to be read are dealt over all cores.
SPREAD_BYTES = 64 << 20
#: Cosines that differ by more have scores that differ in their 9 digits.
NEAR = 8e-9


def _scored(rows: DataFrame, asked: Asked, reads: np.ndarray, limit: int, kind: str) -> DataFrame:
    """(query_id, id, score): of the lists that each query reads, what can be among its ``limit`` best; only these lists are asked of the scan.

    A task compares tiles of vectors with the queries and holds each query's best so far, at most ``limit``.
    """
    lists = [asked.lists[i] for i in np.flatnonzero(reads.any(axis=0)).tolist()]
    some = rows.where(F.col("list").isin(lists)).select("id", "list", "v")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if sum(asked.sizes[x] for x in lists) * 8 * max(asked.groups, default=0) < cores * SPREAD_BYTES:  # few bytes, much work
        some = some.repartition(cores)
    names, id_kind = asked.names, rows.schema["id"].dataType.simpleString()
    name_kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        for batch in batches:
            best = best or Best(len(reads), limit, batch.column(0).type)
            v = batch.column(2)
            dims = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            codes = np.array([asked.place[x] for x in batch.column(1).to_pylist()], int)
            for d in np.unique(dims).tolist():
                if d not in asked.groups:
                    continue
                at = np.flatnonzero(dims == d)
                for tile in np.split(at, range(TILE, len(at), TILE)):
                    best.read(*asked.groups[d], reads, flat[starts[tile][:, None] + np.arange(d)], codes[tile], batch.column(0).take(pa.array(tile)))
        if best is not None and len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array(names, name_kind).take(pa.array(best.query)), best.ids, pa.array(best.score)], ["query_id", "id", "score"])

    return some.mapInArrow(run, f"query_id {kind}, id {id_kind}, score double")


class Best:
    """The best ids of each query by score of 9 digits, ties to the smaller id, as one table in order of queries."""

    def __init__(self, queries: int, limit: int, id_kind: pa.DataType):
        self.limit, self.least = limit, np.full(queries, -np.inf)
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], id_kind)

    def read(self, places: np.ndarray, queries: np.ndarray, reads: np.ndarray, vectors: np.ndarray, codes: np.ndarray, ids: pa.Array) -> None:
        """Compare a tile of vectors in lists ``codes`` with the queries at ``places`` that read these lists."""
        mine = np.flatnonzero(reads[np.ix_(places, np.unique(codes))].any(axis=1))
        if not len(mine):
            return
        places, queries = places[mine], queries[mine]
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit(queries) @ unit(vectors).T
        near[~reads[np.ix_(places, codes)]] = -np.inf
        near[np.isnan(near)] = np.inf  # too large to be squared: told by the scores themselves
        hit = near >= np.maximum(self.least[places], -2.0)[:, None]
        many = np.flatnonzero(hit.sum(axis=1) > self.limit)
        if len(many):
            kth = np.partition(near[many], len(ids) - self.limit, axis=1)[:, len(ids) - self.limit]
            hit[many] &= near[many] >= kth[:, None] - NEAR
        q, v = np.nonzero(hit)
        for at in range(0, len(q), PAIRS):
            some = slice(at, at + PAIRS)
            self.add(places[q[some]], scores(vectors[v[some]], queries[q[some]]), ids.take(pa.array(v[some])))

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        good = score > 0
        query, score, ids = query[good], score[good], ids.filter(pa.array(good))
        touched = np.zeros(len(self.least), bool)
        touched[query] = True
        old = touched[self.query]
        stay = (self.query[~old], self.score[~old], self.ids.filter(pa.array(~old)))
        query, score, ids = np.concatenate([self.query[old], query]), np.concatenate([self.score[old], score]), pa.concat_arrays([self.ids.filter(pa.array(old)), ids])
        told = digits(score)
        order = pc.sort_indices(pa.table({"q": query, "s": told, "id": ids}), sort_keys=[("q", "ascending"), ("s", "descending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        query, score, told, ids = query[order], score[order], told[order], ids.take(pa.array(order))
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        last = place == self.limit - 1
        self.least[query[last]] = told[last] / 5e8 - 1 - NEAR
        top = place < self.limit
        self.query, self.score = np.concatenate([stay[0], query[top]]), np.concatenate([stay[1], score[top]])
        self.ids = pa.concat_arrays([stay[2], ids.filter(pa.array(top))])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(1 + cosine) / 2 of pairs, summed in order of components, to the last bit what semantic.nearest() gives."""
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    with np.errstate(all="ignore"):
        for x, y in zip(a.T, b.T, strict=True):
            ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
        cosine = ab / (np.sqrt(aa) * np.sqrt(bb))
    return np.where(np.isnan(cosine), 1.0, np.maximum(0.0, np.minimum(1.0, (1 + cosine) / 2)))


def digits(score: np.ndarray) -> np.ndarray:
    """Scores in billionths, halves upwards as Spark rounds the decimals of a double."""
    scaled = score * 1e9
    out = np.floor(scaled + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5).tolist():
        out[i] = int((Decimal(repr(float(score[i]))) * 10**9).to_integral_value(ROUND_HALF_UP))
    return out


def _best(rows: DataFrame, limit: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

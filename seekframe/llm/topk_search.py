"""Exact top-k search by no-random-access aggregation over sorted lists.

Components become floor(256 * x); a score is the inner product of those integers. Queries are
searched against every other row, in blocks: queries and candidates are dealt into blocks of bounded
size by a hash of their id, every pair of blocks is one group, and each group's k best per query are
ranked again over all groups (k rows a group and query).

In a block of candidates each dimension is a list sorted by size of component, largest first. For a query,
the lists are read in order, all down to the same contribution |q_d * c_d|, which falls round by round.
What a candidate has been seen with sums up; what it has not been seen with is within plus or minus the last
contribution read of any such list, times their number. So every candidate has a lower and an upper bound. Those whose upper
bound is below the k-th best lower bound cannot qualify any more; reading stops once the others are few,
and their scores are then resolved in full.

Ties go to the smaller id. Vectors that are null, empty or hold null or non-finite components, and null ids,
take no part; vectors of another length than the query's are not comparable and not its candidates. Rows that
share the query's id are its own. Other repeated rows count each. No vectors or no queries: no rows.

Scores are exact integers. Bounds are summed in doubles, less or more a margin for their rounding where products don't
fit 53 bits; what they leave is resolved in doubles, 64-bit integers or Python's integers, the first of these that
hold any product of the block. A reported score that doesn't fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.tables import table

K = 5
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 8192
#: Below these, sums of products are exact in doubles and in 64-bit integers.
EXACT, LONG = 2.0**53, 2.0**62
#: Partitions of the pairs of blocks, at most.
GROUPS = 20_000
#: Contributions down to which lists are read, as parts of a typical one. Above the first bounds leave nearly all candidates.
ROUNDS = (0.25, 0.1, 0.0)
#: Reading stops when one candidate in so many is left: their scores cost less than reading on.
LEFT = 4


class Lists:
    """A block of candidates as one sorted list per dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors)
        order = np.argsort(-size, axis=0, kind="stable")
        self.ids = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, 0).T)
        self.falling = -np.abs(self.values)
        self.typical = float(np.sqrt((vectors**2).mean())) if vectors.size else 0.0
        self.most = float(size.max()) if vectors.size else 0.0
        self.whole: np.ndarray | None = None  # the vectors as integers, made when doubles don't do

    def survivors(self, query: np.ndarray, k: int) -> np.ndarray:
        """Candidates that bounds leave in the running for the k best; at least the k best."""
        n, dims = self.vectors.shape
        few = max(4 * k, n // LEFT)
        alive = np.arange(n)
        if n <= few:
            return alive
        weight = np.abs(query)
        product = dims * self.most * float(weight.max())
        margin = 0.0 if product < EXACT else product * dims * 2.0**-50
        level = self.typical * float(np.sqrt((query**2).mean()))
        read = np.zeros(dims, np.int64)
        sums, seen = np.zeros(n), np.zeros(n, np.int64)
        for part in ROUNDS:
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(weight > 0, part * level / weight, np.inf)
            deep = np.array([np.searchsorted(self.falling[d], -least[d], "right") for d in range(dims)]) if part else np.full(dims, n)
            deep = np.maximum(deep, read)
            ids = np.concatenate([self.ids[d, a:b] for d, (a, b) in enumerate(zip(read, deep, strict=True))])
            got = np.concatenate([self.values[d, a:b] * query[d] for d, (a, b) in enumerate(zip(read, deep, strict=True))])
            sums += np.bincount(ids, weights=got, minlength=n)
            seen += np.bincount(ids, minlength=n)
            read = deep
            most = np.where(read < n, weight * -self.falling[np.arange(dims), np.minimum(read, n - 1)], 0.0).max()
            slack = (dims - seen[alive]) * most
            own = sums[alive]
            kth = np.partition(own - slack, len(alive) - k)[len(alive) - k]
            alive = alive[own + slack >= kth - margin]
            if len(alive) <= few:
                break
        return alive

    def resolved(self, query: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """The exact scores of ``alive``, as 64-bit or as Python's integers."""
        product = self.vectors.shape[1] * self.most * float(np.abs(query).max()) if self.vectors.size else 0.0
        if product < EXACT:
            return (self.vectors[alive] @ query).astype(np.int64)
        kind = np.int64 if product < LONG else object
        if self.whole is None or self.whole.dtype != kind:
            self.whole = self.vectors.astype(np.int64) if kind is np.int64 else np.array([[int(x) for x in v] for v in self.vectors], object)
        own = query.astype(np.int64) if kind is np.int64 else np.array([int(x) for x in query], object)
        return self.whole[alive] @ own

    def best(self, query: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best but ``own`` ones, ties to smaller ids."""
        alive = self.survivors(query, min(k + len(own), len(self.vectors)))
        if len(own):
            alive = np.setdiff1d(alive, own)
        scores = self.resolved(query, alive)
        if scores.dtype == object:
            first = np.array(sorted(range(len(alive)), key=lambda i: (-scores[i], ids[alive[i]]))[:k], np.int64)
            if any(abs(scores[i]) >= 1 << 63 for i in first):
                raise OverflowError("a score doesn't fit 64 bits")
        else:
            first = np.lexsort((ids[alive], -scores))[:k]
        return alive[first], scores[first].astype(np.int64)


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not candidates.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        q_ids, q = _matrix(queries)
        ids, c = _matrix(candidates)
        lists = Lists(c)
        by_id = np.argsort(ids, kind="stable")
        sorted_ids = ids[by_id]
        out_q, out_v, out_s = [], [], []
        for i in range(len(q)):
            own = by_id[np.searchsorted(sorted_ids, q_ids[i], "left") : np.searchsorted(sorted_ids, q_ids[i], "right")]
            at, scores = lists.best(q[i], own, ids, k)
            out_q.append(np.full(len(at), q_ids[i]))
            out_v.append(ids[at])
            out_s.append(scores)
        join = lambda parts: pa.array(np.concatenate(parts).astype(np.int64))
        return pa.table([join(out_q), join(out_v), join(out_s)], names)

    return run


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vectors = rows.column("v").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    whole = np.floor(256.0 * flat.astype(np.float64))
    if not np.isfinite(whole).all():
        raise OverflowError("a component doesn't fit a double when multiplied by 256")
    return rows.column("id").to_numpy(), whole.reshape(len(vectors), -1)


def search(vectors: DataFrame, is_query: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which the SQL condition on ``id`` holds."""
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(fine)
    queries = rows.where(is_query)
    sizes = rows.agg(F.count("*").alias("c"), F.count_if(F.expr(is_query)).alias("q")).first()
    n_c, n_q = max(1, -(-sizes["c"] // candidate_block)), max(1, -(-sizes["q"] // query_block))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select("id", "v", F.size("v").alias("dims"), block(n_q).alias("q"), others(n_c).alias("c"))
    right = rows.select("id", "v", F.size("v").alias("dims"), block(n_c).alias("c"), others(n_q).alias("q"))
    keys = ["dims", "q", "c"]
    # as many partitions as groups: they are few bytes and much work, and would be coalesced otherwise
    left, right = (side.repartition(min(n_c * n_q, GROUPS), *keys) for side in (left, right))
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best matches of every 50th vector among all others."""
    return search(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

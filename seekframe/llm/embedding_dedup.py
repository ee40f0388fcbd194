"""Embedding near-dedup: PCA-ordered tiled comparison of vectors with equal labels.

Two vectors link when their cosine, in double precision, is at least ``threshold``. Vectors that are null,
empty, zero or hold null or non-finite components, and null labels or ids, link with nothing; neither do vectors of
different lengths.

Unit vectors are turned to their principal axes (fitted on at most ``SAMPLE`` rows; the axes decide the
speed, never the result). Vectors that link differ by at most sqrt(2 - 2 * threshold) along every axis, so
cells of that width along the first two axes only meet themselves and the eight around them. A cell of a label is
dealt by hash into tiles of about ``TILE`` vectors; every pair of tiles that may hold links is one group, so a
label or cell with any share of the rows becomes many bounded groups. In a pair of tiles the leading axes'
products are summed first; with the product of the remaining norms they bound the cosine, and pairs that
cannot reach the threshold are left. The rest get further axes, and close calls the cosine in the
original axes. Of its links a group returns each vector's number and a tree that spans them, never the pairs.

Every row is a vector of its own, also where rows repeat an id: they link like any others, ``n_links`` counts linked rows,
and each row is returned. A null id keeps its rows, each alone, with a null component and kept. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm.components import components
from seekframe.llm.scratch import Scratch
from seekframe.tables import table

THRESHOLD = 0.98
TILE = 2048
SAMPLE = 20_000
#: A label of more tiles than this is cut along the second axis too.
FINE = 8
STRIP = 512
LEADING = (8, 16, 32)
CLOSE = 1e-9


def principal_axes(rows: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Axes by vector length, columns by falling variance, from the ``sample`` rows of least id hash."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    by_length: dict[int, list[np.ndarray]] = {}
    for v in some:
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        by_length.setdefault(len(x), []).append(x)
    axes = {}
    for n, vs in by_length.items():
        x = np.array(vs)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        axes[n] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return axes


def _unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, unit vectors) as doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1)
    scaled = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _cells(axes: dict[int, np.ndarray], width: float):
    first = {n: a[:, :2] for n, a in axes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            lengths = np.diff(vectors.offsets.to_numpy())
            cell = np.zeros((len(vectors), 2), np.int32)
            for n in np.unique(lengths):
                of = np.flatnonzero(lengths == n)
                along = first.get(int(n))
                along = np.eye(int(n))[:, :2] if along is None else along
                cell[of, : along.shape[1]] = np.floor(_unit(vectors.take(pa.array(of)))[1] @ along / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(cell[:, 0]), pa.array(cell[:, 1])], [*batch.schema.names, "dims", "x", "y"])

    return run


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b) with a cosine of at least ``threshold``; a and b hold vectors as they are."""
    ua, ub = (_normed(x) for x in (a, b))
    ta, tb = ua @ axes, ub @ axes
    dims = a.shape[1]
    steps = [k for k in LEADING if k < dims]
    rest = lambda t, k: np.sqrt(np.maximum((t[:, k:] ** 2).sum(axis=1), 0))
    rows, cols = [], []
    for at in range(0, len(a), STRIP):
        t = ta[at : at + STRIP]
        if steps:
            k = steps[0]
            part = t[:, :k] @ tb[:, :k].T
            r, c = np.nonzero(part + np.outer(rest(t, k), rest(tb, k)) >= threshold - CLOSE)
            if len(r) <= part.size // 16:
                cos = part[r, c]
                for k, more in zip(steps, [*steps[1:], dims], strict=True):
                    cos = cos + np.einsum("ij,ij->i", t[r, k:more], tb[c, k:more])
                    bound = cos if more == dims else cos + rest(t, more)[r] * rest(tb, more)[c]
                    stay = bound >= threshold - CLOSE
                    r, c, cos = r[stay], c[stay], cos[stay]
                close = cos < threshold + CLOSE
                stay = np.ones(len(r), bool)
                stay[close] = _cosines(a, b, at + r[close], c[close]) >= threshold
                rows.append(at + r[stay])
                cols.append(c[stay])
                continue
        cos = t @ tb.T
        hit = cos >= threshold + CLOSE
        r, c = np.nonzero((cos >= threshold - CLOSE) & ~hit)
        hit[r, c] = _cosines(a, b, at + r, c) >= threshold
        r, c = np.nonzero(hit)
        rows.append(at + r)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _normed(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _cosines(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, y = a[r], b[c]
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def roots(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over edges (r, c)."""
    least = np.arange(n)
    while len(r):
        low = np.minimum(least[r], least[c])
        after = least.copy()
        np.minimum.at(after, r, low)
        np.minimum.at(after, c, low)
        after = after[after]
        if (after == least).all():
            break
        least = after
    return least


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(tile: pa.Table) -> pa.Table:
        names = ["id", "links", "root"]
        tile = tile.combine_chunks()
        side = tile.column("right").to_numpy()
        ids = tile.column("id").to_numpy()
        order = np.lexsort((ids, side))
        ids, side = ids[order], side[order]
        x = tile.column("v").combine_chunks().take(pa.array(order))
        x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        split = int(np.searchsorted(side, 1))
        own = tile.column("own")[0].as_py()
        turn = axes.get(x.shape[1])
        turn = np.eye(x.shape[1]) if turn is None else turn
        if own:
            r, c = linked(x, x, turn, threshold)
            r, c = r[r < c], c[r < c]
        elif split == 0 or split == len(ids):
            return pa.table([pa.array([], pa.int64())] * 3, names)
        else:
            r, c = linked(x[:split], x[split:], turn, threshold)
            c = c + split
        links = np.bincount(r, minlength=len(ids)) + np.bincount(c, minlength=len(ids))
        has = np.flatnonzero(links)
        return pa.table([pa.array(ids[has]), pa.array(links[has]), pa.array(ids[roots(len(ids), r, c)[has]])], names)

    return run


def links(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(id, links, root) per tile pair and linked vector. ``vectors``: (id long, label, v) of vectors that take part."""
    axes = principal_axes(vectors)
    # a little over the widest difference, for rounding
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    label = vectors.schema["label"].dataType.simpleString()
    kind = vectors.schema["v"].dataType.simpleString()
    rows = scratch.keep(vectors.mapInArrow(_cells(axes, width), f"id long, label {label}, v {kind}, dims int, x int, y int"))
    counts = rows.groupBy("label", "dims", "x", "y").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("label", "dims").agg(F.sum("c").alias("size"))
    # a label of few tiles isn't cut along the second axis: that would only make many small groups
    cells = counts.join(sizes, ["label", "dims"]).select("label", "dims", "x", "y", "c", F.when(F.col("size") > FINE * tile, F.col("y")).otherwise(0).alias("z"))
    site = ["label", "dims", "x", "z"]
    n = cells.groupBy(*site).agg(F.ceil(F.sum("c") / tile).cast("int").alias("n"))
    # each cell's tiles are told to the cells around it: at most nine entries a cell
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    told = n.select(*site, "n", steps.alias("d")).select("label", "dims", (F.col("x") - F.col("d.dx")).alias("x"), (F.col("z") - F.col("d.dy")).alias("z"), F.struct("d.dx", "d.dy", "n").alias("near"))
    around = cells.drop("c").join(told.groupBy(*site).agg(F.collect_list("near").alias("near")), site)
    own = F.filter("near", lambda e: (e["dx"] == 0) & (e["dy"] == 0))[0]["n"]
    dealt = rows.join(around, ["label", "dims", "x", "y"]).withColumn("t", F.pmod(F.xxhash64("id"), own).cast("int"))
    x, y, t = F.col("x"), F.col("z"), F.col("t")

    def meets(e: Column) -> Column:
        """The pairs of tiles in which a vector meets those of a cell around it; the cell that comes first is on the left."""
        inside = (e["dx"] == 0) & (e["dy"] == 0)
        ahead = (e["dx"] > 0) | ((e["dx"] == 0) & (e["dy"] > 0))

        def pair(o: Column) -> Column:
            left = F.when(inside, t <= o).otherwise(ahead)
            mine, other = F.struct(x.alias("x"), y.alias("y"), t.alias("t")), F.struct((x + e["dx"]).alias("x"), (y + e["dy"]).alias("y"), o.alias("t"))
            return F.struct(F.when(left, mine).otherwise(other).alias("a"), F.when(left, other).otherwise(mine).alias("b"), F.when(left, 0).otherwise(1).alias("right"))

        return F.transform(F.sequence(F.lit(0), e["n"] - 1), pair)

    met = dealt.select("label", "dims", "id", "v", F.explode(F.flatten(F.transform("near", meets))).alias("m")).select("label", "dims", "id", "v", "m.*")
    met = met.withColumn("own", F.col("a") == F.col("b"))
    return met.groupBy("label", "dims", "a", "b").applyInArrow(_compare(axes, threshold), "id long, links long, root long")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # kept, so that a row's number stays its own
    numbered = scratch.keep(rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("row", F.monotonically_increasing_id()))
    some = numbered.where("fine").select(F.col("row").alias("id"), "label", "v")
    found = scratch.keep(links(some, scratch, threshold, tile))
    count = found.groupBy("id").agg(F.sum("links").alias("n"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "row")
    least = numbered.select("row", "id").join(parts, "row").groupBy("component").agg(F.min("id").alias("component_id"))
    out = numbered.select("id", "row").join(count.withColumnRenamed("id", "row"), "row", "left").join(parts, "row", "left").join(least, "component", "left")
    component = F.coalesce("component_id", "id")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return scratch.finish(out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), kept.alias("kept")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label, by component."""
    return dedup(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings),
v AS (
  SELECT r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM e
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM v a JOIN v b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98
),
reach(a, b, id) AS (SELECT a, b, id FROM links UNION SELECT x.a, l.b, l.id FROM reach x JOIN links l ON x.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), m AS (SELECT a, min(id) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, coalesce(vec_id <= coalesce(m, vec_id), TRUE) AS kept
FROM e LEFT JOIN n ON r = n.a LEFT JOIN m ON r = m.a
"""

"""Substring dedup by level-wise doubling.

A window is ``words`` consecutive words of one document. A window is *repeated* when its word
sequence also starts in a document with a smaller id, and every word that a repeated window covers
goes. Windows are judged on the input.

Levels. The first level has windows of half the length. A longer window can only repeat if all its
halves do, so of the halves that start in it only the one with the least hash, the same in every
document, is looked up; that is a fourteenth of all positions. Only windows whose least half is found
in two different texts are extended to twice the length and compared in full, by two independent hashes of 64
bits each, in which every step is mixed anew. Levels end
at ``words``: a longer window covers no word that those of ``words`` don't, so there's nothing left
to extend; they end sooner when no candidate survives.

Texts with the same words, by the SHA-256 of the words, are one text: all but the one with the smallest id are removed entire
(if they have a window), and only that one is compared with other texts. So thousands of copies
cost as many small rows, and no group of copies meets in one task.

A null text has no words. A row with a null id is not smaller than any other, and none is smaller
than it: nothing is removed from it. Rows with the same id are not smaller than each other; each
gets its own result. Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm.scratch import Scratch
from seekframe.llm.words import Hasher, Piece, pieces
from seekframe.tables import table

WORDS = 50


class Windows:
    """Window hashes of a piece's words."""

    def __init__(self, words: int):
        self.words, self.half = words, words // 2
        self.hashers = Hasher(1), Hasher(2)

    def hashes(self, piece: Piece, of: int) -> np.ndarray:
        return self.hashers[of].of_bytes(piece.data, piece.starts, piece.ends)

    def full(self, words: np.ndarray, of: int) -> np.ndarray:
        """The hash of the window that starts at each word, two halves of the level before."""
        halves = self.hashers[of].runs(words, self.half)
        return self.hashers[of].pairs(halves[: -self.half], halves[self.half :])

    def starts(self, piece: Piece) -> np.ndarray:
        """The words at which a window of one text starts."""
        n = len(piece.starts)
        last = np.repeat(piece.words[1:], np.diff(piece.words)) - self.words
        return np.flatnonzero(np.arange(n) <= last)

    def least_halves(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each window, the least hash of the halves that start in it."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        least = self.hashers[0].runs(words, self.half)
        span, reach = self.words - self.half + 1, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        rest = span - reach
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        return least[starts]


def _whole(piece: Piece) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(hexadecimal digests of each text's words, joined by one space; their first two longs, which name a class of copies)."""
    digests = [hashlib.sha256(b" ".join(piece.data[a:b].tobytes().split())) for a, b in _byte_bounds(piece)]
    names = np.frombuffer(b"".join(d.digest()[:16] for d in digests), ">i8").reshape(-1, 2).astype(np.int64)
    return [d.hexdigest() for d in digests], names[:, 0], names[:, 1]


def _texts_pass(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(words)
        for batch in batches:
            for piece in pieces(batch.column("text")):
                n = len(piece)
                starts = windows.starts(piece)
                least = windows.least_halves(windows.hashes(piece, 0), starts) if len(starts) else np.zeros(0, np.uint64)
                new = np.ones(len(least), bool)  # neighbours mostly share their least half
                text_of = np.searchsorted(piece.words, starts, "right") - 1
                new[1:] = (least[1:] != least[:-1]) | (text_of[1:] != text_of[:-1])
                least, text_of = least[new], text_of[new]
                bounds = np.searchsorted(text_of, np.arange(n + 1)).astype(np.int32)
                whole, c1, c2 = _whole(piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(piece.first, n),
                        pa.array(np.diff(piece.words)),
                        pa.array(c1),
                        pa.array(c2),
                        pa.array(whole, pa.string()),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(least.view(np.int64))),
                    ],
                    ["id", "n", "c1", "c2", "whole", "halves"],
                )

    return run


def _byte_bounds(piece: Piece) -> list[tuple[int, int]]:
    """From each text's first word to its last, in bytes."""
    lo, hi = piece.words[:-1], piece.words[1:]
    full = hi > lo
    a = np.zeros(len(lo), np.int64)
    b = np.zeros(len(lo), np.int64)
    a[full], b[full] = piece.starts[lo[full]], piece.ends[hi[full] - 1]
    return list(zip(a.tolist(), b.tolist(), strict=True))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add c1, which names the class of a text's copies, to candidates."""
    for batch in batches:
        c1 = [_whole(p)[1] for p in pieces(batch.column("text"))]
        c1 = np.concatenate(c1) if c1 else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1)], [*batch.schema.names, "c1"])


def _windows_pass(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(words)
        for batch in batches:
            known = batch.column("halves")
            values, offsets = known.values.to_numpy(zero_copy_only=False).view(np.uint64), known.offsets.to_numpy()
            ids, c1 = batch.column("id").to_numpy(zero_copy_only=False), batch.column("c1").to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column("text")):
                starts = windows.starts(piece)
                if not len(starts):
                    continue
                first, second = windows.hashes(piece, 0), windows.hashes(piece, 1)
                least = windows.least_halves(first, starts)
                text_of = np.searchsorted(piece.words, starts, "right") - 1
                hit = np.zeros(len(starts), bool)
                cuts = np.searchsorted(text_of, np.arange(len(piece) + 1))
                for i in range(len(piece)):
                    a, b = cuts[i], cuts[i + 1]
                    if a < b:
                        row = piece.first + i
                        hit[a:b] = np.isin(least[a:b], values[offsets[row] : offsets[row + 1]])
                at, row = starts[hit], text_of[hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(windows.full(first, 0)[at].view(np.int64)),
                        pa.array(windows.full(second, 1)[at].view(np.int64)),
                        pa.array(ids[piece.first + row]),
                        pa.array(c1[piece.first + row]),
                        pa.array((at - piece.words[row]).astype(np.int32)),
                    ],
                    ["w1", "w2", "id", "c1", "at"],
                )

    return run


def _cut_pass(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            removed, kept, digests = [], [], []
            for i in range(batch.num_rows):
                own = texts[i].as_py().split()
                change = np.zeros(len(own) + 1, np.int32)
                at = np.asarray(batch.column("starts")[i].values)
                change[at] += 1
                np.add.at(change, at + words, -1)
                stays = np.cumsum(change[:-1]) == 0
                left = b" ".join([w for w, k in zip(own, stays.tolist(), strict=True) if k])
                removed.append(len(own) - int(stays.sum()))
                kept.append(left)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("c1"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "c1", "n_removed", "kept_sha256", "kept"],
            )

    return run


def repeated_windows(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """What the levels find: (texts, candidates, spans, the scratch that holds them).

    * texts: (id, n, c1, c2, whole, first) of every row; ``first`` is the smallest id with the same words,
    * candidates: (id, c1, text) of the texts that had a candidate window,
    * spans: (id, c1, starts), the repeated windows' first words.
    """
    if words < 2 or words % 2:
        raise ValueError("windows are doubled from half their length: an even number of words")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = scratch.keep(source.mapInArrow(_texts_pass(words), f"id {kind}, n long, c1 long, c2 long, whole string, halves array<long>"))
    # kept for the same reason as below: copies of one text are many rows of one key
    firsts = scratch.keep(rows.groupBy("c1", "c2", "n").agg(F.min("id").alias("first")))
    texts = rows.drop("halves").join(firsts, ["c1", "c2", "n"], "left")

    heads = firsts.where(f"n >= {words} and first is not null").select(F.col("first").alias("id"), "c1").distinct()
    own = rows.where(f"n >= {words}").select("id", "c1", "halves").join(heads, ["id", "c1"], "left_semi")
    halves = scratch.keep(own.select("id", F.explode("halves").alias("half"), "c1").distinct())
    # kept, so that both sides of the join below are shuffled and a hot key's rows can be split
    shared = scratch.keep(halves.groupBy("half").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("half"))
    found = scratch.keep(halves.join(shared, "half", "left_semi").groupBy("id").agg(F.collect_set("half").alias("halves")))
    scratch.drop(halves, shared)

    candidates = scratch.keep(source.join(found, "id").mapInArrow(_named, f"id {kind}, text string, halves array<long>, c1 long"))
    scratch.drop(found)
    windows = scratch.keep(candidates.mapInArrow(_windows_pass(words), f"w1 long, w2 long, id {kind}, c1 long, at int"))
    least = windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    least = scratch.keep(least.drop("last"))
    repeats = windows.join(least, ["w1", "w2"]).where("id > first")
    spans = scratch.keep(repeats.groupBy("id", "c1").agg(F.array_distinct(F.collect_list("at")).alias("starts")))
    scratch.drop(windows, least)
    return texts, candidates.select("id", "c1", "text"), spans, scratch


def dedup(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) for every row.

    ``kept``: the words that stay, joined by one space; null where that's all of them.
    """
    texts, candidates, spans, _ = repeated_windows(docs, words, id_col, text_col)
    kind = spans.schema["id"].dataType.simpleString()
    cut = candidates.join(spans, ["id", "c1"]).select("id", "c1", "text", "starts").mapInArrow(_cut_pass(words), f"id {kind}, c1 long, n_removed long, kept_sha256 string, kept string")
    cut = cut.groupBy("id", "c1").agg(F.first("n_removed").alias("cut"), F.first("kept_sha256").alias("cut_sha256"), F.first("kept").alias("kept"))
    copy = (F.col("id") > F.col("first")) & (F.col("n") >= words)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return texts.join(cut, ["id", "c1"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("cut_sha256", "whole")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word passages that smaller documents have."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least_of AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN least_of USING (k) WHERE doc_id > m),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w) ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

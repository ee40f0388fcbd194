"""Quality classifier: hierarchical empirical Bayes over sites.

Evidence. A logistic regression on ten figures of a text (shares of capitals, symbols and digits, word lengths,
repetition; see ``FIGURES``) is fitted on at most ``LABELLED`` labelled rows, those of least id hash, and gives each
text log odds of being good. Its own share of good labels is taken out, so what's left is evidence alone.

Sites. A host is a document's source, a path its language within it (documents have no address). The global rate of good
texts comes from the evidence on all documents; a host's rate is its documents' mean, shrunk to the global rate; a path's is
its mean, shrunk to its host's. How much is estimated from the same grouped sums, by the moments of a nested analysis of
variance: a mean of n documents counts n / (n + k), with k the variance within paths over that between paths of a host,
or (both of these) over that between hosts. Where groups differ no more than chance would make them, they count for
nothing. A document is left out of its own path, host and global rate, so that its evidence counts once. All are sums
over every document, combined before the shuffle; no group is gathered. A document's posterior log odds are its
evidence plus those of its path's rate. It's kept at log odds of 0 or more.

A text that is null or has no words is rejected, with no evidence, and counts for no site. A null source or language
is a site of its own. Labels of unknown documents, null labels, labels other than 0 and 1, and ids with both are not used;
of rows that repeat a labelled id the one with the least figures is fitted on. Without
both good and bad labels every text with words has no evidence either way. Repeated rows count each. Site figures
are joined by source and language as the optimiser sees fit; their number is that of sites.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekframe.llm.scratch import Scratch
from seekframe.llm.words import Hasher, Piece, pieces
from seekframe.tables import table

LABELLED = 20_000
#: Bounds of the estimated strengths, in documents.
WEAKEST, STRONGEST = 1.0, 1e9
FIGURES = ("capitals", "symbols", "digits", "word_length", "stutter", "repetition", "distinct", "long_words", "line_length", "words")
PHRASE = 4
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "!#$%&*+<=>@[\\]^_`{|}~"]] = True


class Figures:
    """``FIGURES`` of each of a piece's texts."""

    def __init__(self) -> None:
        self.letters, self.runs = Hasher(41), Hasher(42)

    def of(self, piece: Piece) -> np.ndarray:
        counts = np.diff(piece.words)
        size = piece.ends - piece.starts
        text = np.repeat(np.arange(len(counts)), counts)
        total = lambda of: self._sums(of, piece.words)
        share = lambda part, whole: part / np.maximum(whole, 1)
        by_word = lambda hits: np.diff(np.concatenate([[0], np.cumsum(hits)])[np.append(piece.starts, len(piece.data))]) if len(piece.starts) else np.zeros(0)
        upper, lower = (piece.data >= 65) & (piece.data <= 90), (piece.data >= 97) & (piece.data <= 122)
        capitals, small = total(by_word(upper)), total(by_word(lower))
        letters = total(size)
        words = self.letters.of_bytes(piece.data, piece.starts, piece.ends)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        phrases = np.maximum(counts - PHRASE + 1, 0)
        of = np.repeat(np.arange(len(counts)), phrases)
        at = np.arange(len(of)) - np.repeat(np.cumsum(phrases) - phrases, phrases) + np.repeat(piece.words[:-1], phrases)
        distinct = lambda h, t: np.bincount(t[self._firsts(h, t)], minlength=len(counts))
        repeated = share(phrases - distinct(self.runs.runs(words, PHRASE)[at], of), phrases)
        lines = total(by_word(piece.data == 10))
        return np.column_stack(
            [
                share(capitals, capitals + small),
                share(total(by_word(_SYMBOLS[piece.data])), letters),
                share(total(by_word((piece.data >= 48) & (piece.data <= 57))), letters),
                np.log1p(share(letters, counts)),
                share(total(same), counts),
                repeated,
                share(distinct(words, text), counts),
                share(total(size > 24), counts),
                np.log1p(share(counts, lines + 1)),
                np.log1p(counts),
            ]
        )

    @staticmethod
    def _sums(of: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of)])[bounds])

    @staticmethod
    def _firsts(h: np.ndarray, t: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, t))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (t[order][1:] != t[order][:-1])
        return order[new]


def _expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Figures in standard units within plus or minus 4, and their squares."""
    z = np.clip((x - mean) / scale, -4, 4)
    return np.hstack([z, z * z - 1])


class Model:
    """Log odds of a text being good, less those of the labels it was fitted on."""

    def __init__(self, x: np.ndarray, good: np.ndarray, rounds: int = 25, decay: float = 1.0):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(len(FIGURES))
        self.scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(len(FIGURES))
        self.weights, self.constant = np.zeros(2 * len(FIGURES)), 0.0
        rate = good.mean() if len(good) else 0.5
        if 0 < rate < 1:
            z = np.hstack([_expanded(x, self.mean, self.scale), np.ones((len(x), 1))])
            w = np.zeros(z.shape[1])
            ridge = np.diag([*[decay] * (z.shape[1] - 1), 1e-9])
            for _ in range(rounds):  # Newton's method
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + ridge, z.T @ (good - p) - ridge @ w)
                w = w + step
                if np.abs(step).max() < 1e-9:
                    break
            self.weights, self.constant = w[:-1], w[-1] - np.log(rate / (1 - rate))

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_expanded(x, self.mean, self.scale) @ self.weights + self.constant, -30, 30)


def _figures_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    figures = Figures()
    for batch in batches:
        for piece in pieces(batch.column("text")):
            x = figures.of(piece)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(piece.first, len(x)) for c in ("id", "good")], rows], ["id", "good", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """The evidence model, from a bounded sample of labelled texts brought to the driver as figures."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    some = some.agg(F.min(label_col).cast("int").alias("good"), F.max(label_col).cast("int").alias("most")).where("good = most").select("id", "good")
    some = some.orderBy(F.xxhash64("id"), "id").limit(labelled)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    each = texts.join(F.broadcast(some), "id").select("id", "text", "good").mapInArrow(_figures_pass, f"id {kind}, good int, x array<double>")
    found = each.groupBy("id").agg(F.min("x").alias("x"), F.min("good").alias("good")).toArrow()
    found = found.take(pc.sort_indices(found, [("id", "ascending")]))  # sums of doubles depend on their order
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FIGURES))
    return Model(x, found.column("good").to_numpy().astype(float))


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text", name: str = "evidence") -> DataFrame:
    """``docs`` with a column of log odds, null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = Figures()
        for batch in batches:
            for piece in pieces(batch.column(text_col)):
                odds = pa.array(model.evidence(figures.of(piece)), mask=np.diff(piece.words) == 0)
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([*part.columns, odds], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def strengths(t: dict[str, float]) -> tuple[float, float]:
    """(host's, path's) k, in documents, from the sums that ``sites`` totals."""
    n, paths, hosts = t["n"], t["paths"], t["hosts"]
    if n <= paths:
        return STRONGEST, STRONGEST
    within = max((t["q"] - t["path_squares"]) / (n - paths), 0.0)
    path_size = n - t["path_sizes"]
    between = ((t["path_squares"] - t["host_squares"]) - (paths - hosts) * within) / path_size if path_size > 0 else 0.0
    host_size = n - t["host_sizes"] / n
    mixed = (t["path_sizes"] - t["sizes"] / n) * max(between, 0.0)
    apart = ((t["host_squares"] - t["s"] ** 2 / n) - (hosts - 1) * within - mixed) / host_size if host_size > 0 else 0.0
    k = lambda inner, outer: min(max(inner / outer, WEAKEST), STRONGEST) if outer > 0 else STRONGEST
    return k(within + max(between, 0.0), apart), k(within, between)


def sites(rated: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, float]]:
    """((host, path, n, s, hn, hs) of each path, the totals over all). ``rated``: (host, path, evidence) of every document, kept.

    n documents whose probabilities sum to s, and those of the host. Kept, so that its size is known before documents
    are joined with it, which are then shuffled only if it is large.
    """
    good = 1 / (1 + F.exp(-F.col("evidence")))
    path = rated.where("evidence is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("s"), F.sum(good * good).alias("q"))
    host = path.groupBy("host").agg(
        F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("q"), F.count("*").alias("paths"), F.sum(F.col("s") ** 2 / F.col("n")).alias("path_squares"), F.sum(F.col("n").cast("double") ** 2).alias("sizes"),
    )
    total = {"n": "hn", "s": "hs", "q": "q", "paths": "paths", "path_squares": "path_squares", "sizes": "sizes", "host_squares": "hs * hs / hn", "path_sizes": "sizes / hn", "host_sizes": "cast(hn as double) * hn"}
    row = host.agg(F.count("*").alias("hosts"), *[F.sum(F.expr(e)).alias(k) for k, e in total.items()]).first()  # one row; null sums without documents
    whole = {k: float(v or 0) for k, v in row.asDict().items()}
    named = host.select(F.col("host").alias("h"), "hn", "hs")
    return scratch.keep(path.drop("q").join(named, F.col("host").eqNullSafe(F.col("h"))).drop("h")), whole


def _judged(rated: DataFrame, found: tuple[DataFrame, dict[str, float]], host: str = "host", path: str = "path", evidence: str = "evidence") -> DataFrame:
    """``rated`` with the struct ``site_odds`` of prior and posterior, a document being left out of its own site."""
    known, whole = found
    host_k, path_k = strengths(whole)
    at = known.select(F.struct("*").alias("site"))
    both = rated.join(at, F.col(host).eqNullSafe(F.col("site.host")) & F.col(path).eqNullSafe(F.col("site.path")), "left")
    own = 1 / (1 + F.exp(-F.col(evidence)))
    rate = (whole["s"] - own + 0.5) / whole["n"]  # of the others, and half a good and a bad one
    rate = F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))
    rate = (F.col("site.hs") - own + host_k * rate) / (F.col("site.hn") - 1 + host_k)
    rate = (F.col("site.s") - own + path_k * rate) / (F.col("site.n") - 1 + path_k)
    rate = F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))
    prior = F.when(F.col(evidence).isNotNull(), F.ln(rate / (1 - rate)))
    return both.withColumn("site_odds", F.struct(prior.alias("prior"), (F.col(evidence) + prior).alias("posterior"))).drop("site")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(id, evidence, prior, posterior, kept) for every row; all log odds, null for texts without words."""
    model = fit(docs, labels, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "quality")
    named = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    rated = scratch.keep(with_evidence(named, model).drop("text"))
    posterior = F.col("site_odds.posterior")
    told = _judged(rated, sites(rated, scratch)).select(F.col("id").alias(id_col), "evidence", "site_odds.prior", posterior.alias("posterior"), F.coalesce(posterior >= 0, F.lit(False)).alias("kept"))
    return scratch.finish(told)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with their columns.

    The rows are kept with their evidence, so that texts are taken apart once; they are not shuffled unless sites are many.
    """
    model = fit(docs, labels, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "quality")
    names = {c.lower() for c in docs.columns}
    free = next(n for n in (f"evidence_{i}" for i in range(len(names) + 1)) if n not in names)
    rated = scratch.keep(with_evidence(docs, model, text_col, free))
    found = sites(rated.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(free).alias("evidence")), scratch)
    rows = rated.select(F.struct(*docs.columns).alias("row"), F.col(host_col).alias("h"), F.col(path_col).alias("p"), F.col(free).alias("e"))
    return _judged(rows, found, "h", "p", "e").where("site_odds.posterior >= 0").select("row.*")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality verdict on every document."""
    verdicts = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rounded = [F.round(c, 6).alias(c) for c in ("evidence", "prior", "posterior")]
    return verdicts.select("doc_id", *rounded, "kept")

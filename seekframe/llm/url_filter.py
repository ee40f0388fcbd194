"""URL filters: exact rules first, else a logistic regression on hashed character n-grams.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased. Path: from
there up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has both empty.

A rule is a host and the start of a path; it fits that host and all its subdomains. The longest
fitting rule decides; of equally long ones, a block. Without one, the model does: a URL is blocked
where its probability is 0.5 or more. The model's features are the distinct 3- to 5-grams of
``^host$`` and of ``^path$``, hashed apart into 2^16 places and scaled to length 1. It is trained
on the driver from a labelled table of at most ``MAX_LABELLED`` rows; more is an error, not a sample. The table that
the query uses (labelled_urls.py) names public sites and invented ones, none of them a site of the pages.

The model's constant is fixed at the log odds of ``PRIOR``, so an address with little to go by, such as
an empty host and path, is allowed.
Nothing is shuffled; repeated rows repeat, an empty table gives no rows, and only the columns named are read. Without
labels, or with one kind of them, the model still gives a verdict: its constant's, or near it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm.labelled_urls import labelled_urls
from seekframe.llm.words import Hasher, text_arrays
from seekframe.tables import table

HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"
PLACES = 1 << 16
GRAMS = (3, 4, 5)
MAX_LABELLED = 100_000
PRIOR = 0.1  # share of URLs thought bad before any is seen
#: (verdict, host, path), the rules of the production query
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)" + HOST, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)" + PATH, 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null.

    Each suffix of the host is looked up among the rules by host, so the cost follows the labels
    of the host and the rules of one host, not all rules. Without rules none fits.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append((rule_path, verdict))
    rank = lambda h, p, v: F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "block").alias("block"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
    known = F.create_map(*[x for h, ps in by_host.items() for x in (F.lit(h), F.array(*[rank(h, p, v) for p, v in ps]))])
    known = known if by_host else F.create_map().cast("map<string, array<struct<size: int, block: boolean, path: string, rule: string, verdict: string>>>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


class Grams:
    """Hashed n-grams of host and path."""

    def __init__(self) -> None:
        self.hashers = (Hasher(11), Hasher(12))

    def places(self, hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the distinct features of each row, ordered by row."""
        keys = []
        for hasher, texts in zip(self.hashers, (hosts, paths), strict=True):
            n = len(texts)
            data, bounds = text_arrays(texts)
            part = data[bounds[0] : bounds[-1]]
            at = np.arange(len(part)) + 2 * np.repeat(np.arange(n), np.diff(bounds)) + 1
            marked = np.empty(len(part) + 2 * n, np.uint8)
            marked[at] = part
            marks = bounds - bounds[0] + 2 * np.arange(n + 1)
            marked[marks[:-1]], marked[marks[1:] - 1] = 94, 36
            rows = np.repeat(np.arange(n), np.diff(marks))
            ends = np.repeat(marks[1:], np.diff(marks))
            for size in GRAMS:
                starts = np.flatnonzero(np.arange(len(marked)) + size <= ends)
                place = hasher.of_bytes(marked, starts, starts + size) >> np.uint64(48)
                keys.append(rows[starts].astype(np.uint64) * np.uint64(PLACES) + place)
        both = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        return (both >> np.uint64(16)).astype(np.int64), (both & np.uint64(PLACES - 1)).astype(np.int64)

    def scores(self, hosts: pa.Array, paths: pa.Array, weights: np.ndarray, constant: float) -> np.ndarray:
        rows, places = self.places(hosts, paths)
        counts = np.bincount(rows, minlength=len(hosts))
        sums = np.bincount(rows, weights=weights[places], minlength=len(hosts))
        return sums / np.sqrt(np.maximum(counts, 1)) + constant


def train(hosts: list[str], paths: list[str], bad: list[int], rounds: int = 150, rate: float = 8.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weights, constant); the weights by accelerated gradient descent on the mean log loss, without randomness."""
    if len(bad) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs are trained on the driver")
    rows, places = Grams().places(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(bad)), 1))
    y, constant = np.asarray(bad, float), float(np.log(PRIOR / (1 - PRIOR)))
    weights = ahead = np.zeros(PLACES)
    for i in range(rounds):
        z = np.bincount(rows, weights=ahead[places], minlength=len(bad)) * scale + constant
        error = (1 / (1 + np.exp(-z)) - y) / max(len(bad), 1)
        after = ahead - rate * (np.bincount(places, weights=(error * scale)[rows], minlength=PLACES) + decay * ahead)
        weights, ahead = after, after + i / (i + 3) * (after - weights)
    return weights, constant


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row. ``labelled``: (url, bad 0 or 1), small."""
    sample = labelled.where("url is not null and bad is not null").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "bad").limit(MAX_LABELLED + 1).toArrow().to_pydict()
    weights, constant = train(sample["host"], sample["path"], sample["bad"])
    weights = weights.astype(np.float32)
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            z = grams.scores(batch.column("host"), batch.column("path"), weights, constant)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z, pa.float64())], [*batch.schema.names, "score"])

    kind = parts.schema["id"].dataType.simpleString()
    rated = parts.mapInArrow(scored, f"id {kind}, host string, path string, score double")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = rated.withColumn("r", rule)
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= 0, "block").otherwise("allow"))
    return ruled.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    labelled = spark.createDataFrame(labelled_urls(), "url string, bad int")
    return judge(table(spark, sf_dir, "pages"), labelled).select("page_id", "host", "path", "rule", "verdict")

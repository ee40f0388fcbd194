"""A training corpus from raw documents, stage by stage.

Each stage gets all that its predecessor kept and returns documents with their own columns; the last returns
digests of what a trainer would read. run() writes every stage's result to the shared scratch folder and
reads it back, so a lost executor costs one stage's tasks and not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm import bpe, mixing, ngram_join, quality, secrets
from seekframe.llm.scratch import Scratch, ship
from seekframe.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of rows that repeat id and text one.

    Rows of one id with different texts are judged each by its own text. Documents without an id can't stand for a group and
    have none; they stay.
    """
    ship(spark)
    names = {c.lower() for c in docs.columns}
    mark = next(n for n in (f"mark_{i}" for i in range(len(names) + 1)) if n not in names)
    marked = docs.withColumn(mark, F.sha2("text", 256))
    first = ngram_join.join(marked, mark_col=mark).where("doc_id = component_id").select("doc_id", F.coalesce(mark, F.lit("")).alias(mark)).distinct()
    # ids that stay have no bound on their number: never broadcast
    kept = marked.withColumn(mark, F.coalesce(mark, F.lit(""))).join(first.hint("merge"), ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars follows the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is read; every document at least once, none of any source over twice."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    return mixing.mix(docs, carry=rest).select(docs.columns)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, per reading."""
    ship(spark)
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", near_copies),
    ("secret scans", secret_scans),
    ("source mix", source_mix),
    ("bpe round trip", bpe_round_trip),
]
#: SQL can't express the fitted classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:  # no later stage reads it
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

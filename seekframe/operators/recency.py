"""What a change log says: how recent a file's changes are, and what changes together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMMITS, LEAST = 50, 0.05


def latest(log: DataFrame, commits: int = COMMITS) -> DataFrame:
    """(commit, place): the newest commits, 0 the newest. ``log``: (commit, at), a row per commit."""
    newest = log.orderBy(F.desc("at"), F.desc("commit")).limit(commits)
    # at most ``commits`` rows by now
    return newest.select("commit", (F.row_number().over(W.orderBy(F.desc("at"), F.desc("commit"))) - 1).alias("place"))


def scores(log: DataFrame, changes: DataFrame, roots: Column, commits: int = COMMITS) -> DataFrame:
    """(path, recency): the best of max(0.05, 1 - place / (commits - 1)). A root commit takes a place and scores nothing."""
    scored = latest(log, commits).where(~roots).select("commit", F.greatest(F.lit(LEAST), 1 - F.col("place") / (commits - 1)).alias("score"))
    return changes.join(F.broadcast(scored), "commit").groupBy("path").agg(F.max("score").alias("recency"))


def changed_together(changes: DataFrame, targets: list[str], most: int = 8) -> DataFrame:
    """(path, commits): other paths by the number of commits that also touch a target."""
    touching = changes.where(F.col("path").isin(*targets)).select("commit").distinct()
    others = changes.where(~F.col("path").isin(*targets)).join(touching, "commit", "left_semi")
    return others.groupBy("path").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "path").limit(most)


def history(changes: DataFrame, paths: list[str], most: int = 5) -> DataFrame:
    """(path, place, commit, at): the newest commits of each path."""
    order = W.partitionBy("path").orderBy(F.desc("at"), F.desc("commit"))
    return changes.where(F.col("path").isin(*paths)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


# Scores of the four kinds of history fragments, and how much each holds.
FRAGMENT_SCORES = {"diff": 0.85, "recent": 0.78, "history": 0.70, "together": 0.60}
RECENT_MOST, TOGETHER_MOST, PATHS_MOST, DIFF_MOST = 8, 8, 5, 6000


def fragments(changes: DataFrame, targets: list[str], diffs: DataFrame | None = None) -> DataFrame:
    """(kind, score, content): what a change log says about some paths, as up to four texts.

    ``changes``: (commit, at, path, message), ``diffs``: (zone, content) of what isn't committed, each zone cut to its first
    ``DIFF_MOST`` characters. Each text is a bounded list; kinds without any line have no row.
    """
    line = lambda *parts: F.concat_ws(" ", *parts)
    listed = lambda rows, kind, order: rows.groupBy(F.lit(kind).alias("kind")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("content"))
    commits = changes.select("commit", "at", "message").distinct().orderBy(F.desc("at"), F.desc("commit")).limit(RECENT_MOST)
    commits = commits.select((-F.row_number().over(W.orderBy("at", "commit"))).alias("n"), line(F.col("commit").cast("string"), "message").alias("line"))
    own = history(changes, targets[:PATHS_MOST]).select(F.struct("path", "place").alias("n"), line("path", F.col("commit").cast("string"), "message").alias("line"))
    others = changed_together(changes, targets, TOGETHER_MOST).select(F.struct((-F.col("commits")).alias("c"), "path").alias("n"), line("path", F.col("commits").cast("string")).alias("line"))
    out = listed(commits, "recent", "n").unionByName(listed(own, "history", "n")).unionByName(listed(others, "together", "n"))
    if diffs is not None:
        cut = diffs.where("content <> ''").select(F.col("zone").alias("n"), line("zone", F.substring("content", 1, DIFF_MOST)).alias("line"))
        out = out.unionByName(listed(cut, "diff", "n"))
    score = F.element_at(F.create_map(*[F.lit(x) for kv in FRAGMENT_SCORES.items() for x in kv]), F.col("kind"))
    return out.select("kind", score.alias("score"), "content").where("content <> ''")

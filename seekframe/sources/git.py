"""What a local git repository says of a folder: its newest commits and what isn't committed, as tables.

Read by the driver through the git program: fifty commits at most, and two bounded texts. Hooks, pagers, filters and
external diffs of the repository's settings are not run.
"""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

COMMITS, DIFF_MOST, SECONDS = 50, 6000, 60
CHANGES = "commit string, at long, path string, message string, root boolean"
_SAFE = ("-c", "core.fsmonitor=false", "-c", f"core.hooksPath={os.devnull}", "-c", "core.pager=cat", "--no-pager", "--no-optional-locks")


def _git(root: str, *args: str) -> bytes:
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_CONFIG_NOSYSTEM": "1", "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    done = subprocess.run(["git", "-C", root, *_SAFE, *args], capture_output=True, timeout=SECONDS, env=env, check=False)
    if done.returncode:
        raise ValueError(f"git can't read {root}: {done.stderr.decode('utf-8', 'replace').strip()[:200]}")
    return done.stdout


def changes(spark: SparkSession, root: str, commits: int = COMMITS) -> DataFrame:
    """(commit, at, path, message, root): the files below ``root`` that each of the newest commits changed, renames by their new name.

    A commit is compared with its first parent; one without a parent has a row with a null path and ``root`` set.
    """
    told = _git(root, "log", "-n", str(commits), "--diff-merges=first-parent", "-M", "--no-ext-diff", "--no-textconv", "--relative", "--name-only", "-z", "--format=%x1e%H%x1f%P%x1f%ct%x1f%s%x1f")
    rows: list[tuple] = []
    for entry in told.decode("utf-8", "replace").split("\x1e")[1:]:
        commit, parents, at, message, names = entry.split("\x1f", 4)
        paths = [p.lstrip("\n") for p in names.split("\0")] if parents else []
        listed = [p for p in paths if p]
        rows += [(commit[:8], int(at), p, message, False) for p in listed] or [(commit[:8], int(at), None, message, not parents)]
    return spark.createDataFrame(rows, CHANGES)


def diffs(spark: SparkSession, root: str) -> DataFrame:
    """(zone, content) of what is staged and what isn't, each cut to its first ``DIFF_MOST`` characters."""
    zones = (("staged", ("--cached",)), ("working", ()))
    rows = [(zone, _git(root, "diff", "--no-ext-diff", "--no-textconv", "--relative", *more).decode("utf-8", "replace")[:DIFF_MOST]) for zone, more in zones]
    return spark.createDataFrame(rows, "zone string, content string")

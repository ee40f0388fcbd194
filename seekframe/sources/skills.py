"""Skills: what their front matter says, and which of them a query asks for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.functions.text import folded, stem

LEAST, MOST = 0.22, 3
QUERIES_MOST = 1_000
# Priorities of a project's own skills and of a registry's.
LOCAL, REGISTERED = 80, 60
SIZE_MOST, NAME_MOST, DESCRIPTION_MOST, COMPATIBILITY_MOST = 65_536, 64, 1024, 500
NAME = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")
# Words that say nothing about a query, English and French.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to use when with "
    "de des du et en la le les pour sur un une avec dans est ce cette ces au aux"
).split()


def words(text: Column) -> Column:
    """The distinct words of a folded text that say something."""
    parts = F.split(text, r"[^\p{L}\p{N}]+")
    return F.array_except(F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def matched(left: Column, right: Column) -> Column:
    """How many words of ``left`` are in ``right``, also by stem."""
    return F.size(F.filter(left, lambda a: F.exists(right, lambda b: (a == b) | (stem(a) == stem(b)))))


def delimited(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text between spaces, once everything but letters, digits and hyphens is one."""
    padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}-]+", " "), F.lit(" "))
    return (F.trim(phrase) != "") & padded.contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def first_of_name(skills: DataFrame) -> DataFrame:
    """One skill per name, ignoring case, the one of highest priority; ``conflict`` where descriptions differ."""
    same = W.partitionBy(F.lower("name"))
    order = same.orderBy(F.desc("priority"), "path", "description")
    marked = skills.withColumn("n", F.row_number().over(order)).withColumn("conflict", F.min("description").over(same) != F.max("description").over(same))
    return marked.where("n = 1").drop("n")


def select(skills: DataFrame, queries: DataFrame, most: int = MOST) -> DataFrame:
    """(query_id, name, path, score, place) of the skills that match each of a few queries best.

    ``skills``: (name, description, path, priority), ``queries``: (query_id, query).
    """
    q = folded(F.col("query"))
    # a literal in each task; more than a few are not for one job
    asked = queries.select("query_id", q.alias("q"), words(q).alias("qw")).limit(QUERIES_MOST + 1).collect()
    if len(asked) > QUERIES_MOST:
        raise ValueError(f"at most {QUERIES_MOST} queries at once")
    literal = F.array(*[F.struct(F.lit(r["query_id"]).alias("query_id"), F.lit(r["q"]).alias("q"), F.array(*[F.lit(w) for w in r["qw"]]).cast("array<string>").alias("qw")) for r in asked])
    plain, hyphened, told = folded(F.replace("name", F.lit("-"), F.lit(" "))), folded(F.col("name")), folded(F.col("description"))
    known = skills.select("name", "path", "priority", plain.alias("plain"), hyphened.alias("hyphened"), told.alias("told"), words(plain).alias("nw"), words(told).alias("dw"))
    both = known.withColumn("asked", F.explode(literal)).select("*", "asked.*").drop("asked")
    exact = delimited(F.col("q"), F.col("plain")) | delimited(F.col("q"), F.col("hyphened"))
    by_name, by_text = matched(F.col("qw"), F.col("nw")), matched(F.col("qw"), F.col("dw"))
    share = lambda part, whole: F.when(F.size(whole) > 0, part / F.greatest(F.size(whole), F.lit(1))).otherwise(0.0)
    of_query = share(matched(F.col("qw"), F.array_union("nw", "dw")), F.col("qw"))
    phrase = (F.length("q") >= 4) & F.col("told").contains(F.col("q"))
    score = F.when(exact, 0.65).otherwise(0.0) + 0.25 * share(by_name, F.col("nw")) + 0.55 * of_query + F.when(phrase, 0.15).otherwise(0.0)
    rated = both.where(exact | (by_name > 0) | (by_text > 0)).withColumn("score", F.least(F.lit(1.0), score)).where(F.col("score") >= LEAST)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("priority"), "name", "path")
    return rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "name", "path", "score", "place")


def front_matter(text: str, folder: str) -> dict:
    """The scalar keys between the first two ``---`` lines; ValueError where they break a rule."""
    if len(text.encode()) > SIZE_MOST:
        raise ValueError("the definition is too large")
    found = re.match(r"---\r?\n(.*?)\r?\n---\s*(\r?\n|$)", text, re.S)
    if not found:
        raise ValueError("no front matter")
    told: dict = {}
    for line in found[1].splitlines():
        if m := re.match(r"([A-Za-z][\w-]*):\s*(.*)$", line):
            told[m[1]] = m[2].strip().strip("\"'")
    name, description = told.get("name", ""), told.get("description", "")
    if not NAME.fullmatch(name) or len(name) > NAME_MOST or name != folder:
        raise ValueError("the name isn't the folder's or not well formed")
    if not 0 < len(description) <= DESCRIPTION_MOST or len(told.get("compatibility", "")) > COMPATIBILITY_MOST:
        raise ValueError("the description or compatibility is missing or too long")
    return told


def defined(told: DataFrame) -> DataFrame:
    """(name, description, path, content) of skill files (path, content) whose front matter keeps the rules; others go."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    head = front_matter(content or "", path.split("/")[-2] if "/" in path else "")
                except ValueError:
                    continue
                rows.append((head["name"], head["description"], path, content))
            yield pd.DataFrame(rows, columns=["name", "description", "path", "content"])

    return told.select("path", "content").mapInPandas(read, "name string, description string, path string, content string")


def whole_or_nothing(chosen: list[tuple[str, int]], budget: int) -> list[str]:
    """Names of skills, in order, whose whole content fits what is left of the budget."""
    out = []
    for name, tokens in chosen:
        if tokens <= budget:
            budget -= tokens
            out.append(name)
    return out

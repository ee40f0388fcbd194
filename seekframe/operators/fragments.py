"""Fragments: lines of a file around what matters, merged where they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, WINDOWS, HEAD = 5, 4, 40
SYMBOL_MARGIN = 2


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def query_windows(files: DataFrame, words: list[str]) -> DataFrame:
    """(path, start_line, end_line): around each of a file's first lines with a word; without any, its head."""
    wanted = F.array(*[F.lit(w) for w in words])
    rows = files.select("path", lines(F.col("content")).alias("l"))
    hits = F.filter(F.transform("l", lambda x, i: F.when(F.exists(wanted, lambda w: F.lower(x).contains(w)), i + 1)), lambda n: n.isNotNull())
    some = rows.select("path", F.size("l").alias("n"), F.slice(hits, 1, WINDOWS).alias("at"))
    around = F.transform("at", lambda i: F.struct(F.greatest(F.lit(1), i - WINDOW).alias("start_line"), F.least(F.col("n"), i + WINDOW).alias("end_line")))
    head = F.array(F.struct(F.lit(1).alias("start_line"), F.least(F.col("n"), F.lit(HEAD)).alias("end_line")))
    return some.select("path", F.explode(F.when(F.size("at") > 0, around).otherwise(head)).alias("w")).select("path", "w.*")


def islands(ranges: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``ranges`` with ``island``: ranges that overlap or touch, a line apart at most, share a number."""
    order = W.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0)
    return ranges.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("opens")


def merged_ranges(ranges: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    return islands(ranges, keys).groupBy(*keys, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def merged(fragments: DataFrame) -> DataFrame:
    """(path, start_line, end_line, type, symbol, score, reasons) of merged fragments.

    The strongest gives type and score, the first of equals; symbols and reasons are united in order.
    """
    row = F.struct("start_line", "end_line", "type", "symbol", "score", "reasons")
    grouped = islands(fragments).groupBy("path", "island").agg(F.array_sort(F.collect_list(row)).alias("f"))
    strongest = F.array_max(F.transform("f", lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("first"), x["type"].alias("type"))))
    named = F.filter(F.transform("f", lambda x: x["symbol"]), lambda s: s.isNotNull() & (F.trim(s) != ""))
    return grouped.select(
        "path",
        F.array_min("f.start_line").alias("start_line"),
        F.array_max("f.end_line").alias("end_line"),
        strongest["type"].alias("type"),
        F.when(F.size(named) > 0, F.array_join(F.array_distinct(named), ", ")).alias("symbol"),
        strongest["score"].alias("score"),
        F.array_distinct(F.flatten("f.reasons")).alias("reasons"),
    )


def text_of(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a content."""
    return F.array_join(F.slice(lines(content), start, end - start + 1), "\n")


def symbol_windows(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, symbol, start_line, end_line, content): a symbol's lines and two around them, within its file."""
    both = symbols.join(files.select("path", "content"), "path").withColumn("n", F.size(lines(F.col("content"))))
    start = F.greatest(F.lit(1), F.col("start_line") - SYMBOL_MARGIN)
    end = F.least(F.col("n"), F.col("end_line") + SYMBOL_MARGIN)
    cut = both.select("path", F.col("qualified").alias("symbol"), start.alias("start_line"), end.alias("end_line"), "content").where("start_line <= end_line")
    return cut.withColumn("content", text_of(F.col("content"), F.col("start_line"), F.col("end_line")))

"""Symbol and usage search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.functions.text import exact_symbol, fuzzy_symbol, path_score, terms
from seekframe.operators import symbol_index

FUZZY_LEAST = 0.62
EXTRA_TERMS = 8


def matches(query: Column) -> Column:
    """Whether a symbol may be meant: a name contains the query, or starts like it and is about as long."""
    name, qualified = F.lower("name"), F.lower("qualified")
    close = (F.substring(name, 1, 1) == F.substring(query, 1, 1)) & (F.abs(F.length("name") - F.length(query)) <= 3)
    return name.contains(query) | qualified.contains(query) | close


def order_of(query: Column) -> list[Column]:
    name, qualified = F.lower("name"), F.lower("qualified")
    rank = F.when(name == query, 0).when(qualified == query, 1).when(name.startswith(query), 2).otherwise(3)
    return [rank, F.col("qualified"), F.col("path"), F.col("start_line"), F.col("provider")]


def _asked(symbols: DataFrame, asks: list[str], index: DataFrame | None) -> DataFrame:
    """``symbols`` with ``ask``: those that each query may mean, by way of an index of their parts if there is one."""
    if index is not None:
        rows = symbol_index.candidates(index, symbols, asks)
    else:
        rows = symbols.withColumn("ask", F.explode(F.array(*[F.lit(a) for a in asks])))
    return rows.where(matches(F.col("ask")))


def find(symbols: DataFrame, queries: list[str], limit: int, index: DataFrame | None = None) -> DataFrame:
    """(query, place, ...symbol): for each of a few literal queries its best symbols. ``index``: of symbol_index.build()."""
    each = _asked(symbols, list(dict.fromkeys(q.lower() for q in queries)), index).withColumnRenamed("ask", "query")
    place = F.row_number().over(W.partitionBy("query").orderBy(*order_of(F.col("query"))))
    return each.withColumn("place", place).where(F.col("place") <= limit)


def scored(symbols: DataFrame, queries: list[str], pool: int, limit: int, index: DataFrame | None = None) -> DataFrame:
    """(query, id, path, exact, fuzzy, path_signal, place): the symbol strategy.

    The pool of a query is what its whole text and each of its first terms find. ``index``: of symbol_index.build().
    """
    spark = symbols.sparkSession
    lows = list(dict.fromkeys(q.lower() for q in queries))
    whole = F.col("query")
    told = spark.createDataFrame([(q,) for q in lows], "query string").withColumn("words", terms(whole))
    told = told.withColumn("ask", F.explode(F.array_distinct(F.concat(F.array(whole), F.slice("words", 1, EXTRA_TERMS)))))
    told = told.select("query", "words", F.lower("ask").alias("ask"))
    asks = sorted({r["ask"] for r in told.select("ask").collect()})  # nine a query
    asked = _asked(symbols, asks, index).join(F.broadcast(told), "ask").withColumn("q", F.struct("query", "words")).drop("query", "words")
    place = F.row_number().over(W.partitionBy("q.query", "ask").orderBy(*order_of(F.col("ask"))))
    pooled = asked.withColumn("n", place).where(F.col("n") <= pool).select("q.query", "q.words", "path", "name", "qualified").distinct()
    exact = exact_symbol(F.col("name"), F.col("qualified"), F.col("query"), F.col("words"))
    fuzzy = fuzzy_symbol(F.col("name"), F.col("qualified"), F.col("words"))
    out = pooled.select("query", F.concat(F.lit("symbol:"), "path", F.lit("#"), "qualified").alias("id"), "path", "qualified", exact.alias("exact"), fuzzy.alias("fuzzy"), path_score(F.col("path"), F.col("words")).alias("path_signal"))
    out = out.where((F.col("exact") > 0) | (F.col("fuzzy") >= FUZZY_LEAST))
    best = F.round(F.greatest("exact", "fuzzy"), 9)
    return out.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc(best), "path", "id"))).where(F.col("place") <= limit)


def usages(relations: DataFrame, text: str, limit: int) -> DataFrame:
    """Relations whose source or target contains the text, by kind, source, target and provider."""
    low = text.lower()
    hit = F.lower("source").contains(low) | F.lower("target").contains(low)
    return relations.where(hit).orderBy("kind", "source", "target", "provider").limit(limit)


def owners(symbols: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(qualified, owner): the least path that declares each type."""
    return symbols.where(F.col("kind").isin(*kinds)).groupBy("qualified").agg(F.min("path").alias("owner"))

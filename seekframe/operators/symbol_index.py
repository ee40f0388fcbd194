"""A stored index of symbols by the three-letter parts of their names, so that a query reads the symbols that it can mean.

A symbol has a row for each distinct part of its lower-cased name and qualified name, and one for the first letter and length of its
name, which is what makes names alike that don't contain the query. A query of three letters or more is contained only where all its
parts are: it counts them (a count filter) and reads seven more keys for the names that are alike. Shorter queries read all symbols.
What is found is compared with the symbol itself, so parts that two symbols share by chance change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART, APART = 3, 3
SYMBOL = ("path", "kind", "name", "qualified", "start_line", "provider")


def identity() -> Column:
    """What a symbol's rows in the index have in common; symbols that share it by chance are told apart later."""
    return F.xxhash64(*SYMBOL)


def _parts(text: Column) -> Column:
    n = F.length(text) - (PART - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(PART)))).otherwise(F.array().cast("array<string>"))


def _like(first: Column, length: Column) -> Column:
    return F.concat(F.lit("\0"), first, length.cast("string"))


def build(symbols: DataFrame) -> DataFrame:
    """(term, path, symbol), to be stored in order of term."""
    name, qualified = F.lower("name"), F.lower("qualified")
    terms = F.array_distinct(F.concat(_parts(F.coalesce(name, F.lit(""))), _parts(F.coalesce(qualified, F.lit(""))), F.array(_like(F.substring(name, 1, 1), F.length("name")))))
    rows = symbols.select("path", identity().alias("symbol"), F.explode(terms).alias("term"))
    return rows.where("term is not null").select("term", "path", "symbol").distinct()


def keys(ask: str) -> list[tuple[str, str, int, int]]:
    """(ask, term, alike, needed) of a lower-cased query: its parts, all needed, and the names that are alike."""
    parts = {ask[i : i + PART] for i in range(len(ask) - PART + 1)}
    lengths = range(max(0, len(ask) - APART), len(ask) + APART + 1)
    return [(ask, p, 0, len(parts)) for p in sorted(parts)] + [(ask, f"\0{ask[:1]}{n}", 1, 0) for n in lengths]


def candidates(index: DataFrame, symbols: DataFrame, asks: list[str]) -> DataFrame:
    """``symbols`` with ``ask``: for each of a few lower-cased queries those that it can mean, and some more."""
    spark = symbols.sparkSession
    long, short = [a for a in asks if len(a) >= PART], [a for a in asks if len(a) < PART]
    out = symbols.withColumn("ask", F.explode(F.array(*[F.lit(a) for a in short]).cast("array<string>"))) if short else None
    if long:
        wanted = [k for a in long for k in keys(a)]
        # as many rows as the queries have letters
        asked = F.broadcast(spark.createDataFrame(wanted, "ask string, term string, alike int, needed int"))
        rows = index.where(F.col("term").isin(sorted({t for _, t, _, _ in wanted}))).join(asked, "term")
        met = rows.groupBy("ask", "symbol").agg(F.sum(1 - F.col("alike")).alias("n"), F.max("alike").alias("alike"), F.max("needed").alias("needed"))
        met = met.where("alike = 1 or n >= needed").select("ask", "symbol")
        found = symbols.withColumn("symbol", identity()).join(met, "symbol").drop("symbol")
        out = found if out is None else out.unionByName(found)
    return out

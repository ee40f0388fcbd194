"""Mixing sources to target weights: temperature mixing in budgeted block permutations.

Weights. A source's share is its part of all tokens (words, ``[^\\x20\\x09-\\x0D]+``). Weights are the shares to the
power of an exponent, normalised. The exponent is found by bisection: the smallest from 0 (all alike) to 1 (as they
are) at which no source repeats more often than ``repeats`` times, or the one at which the weights' entropy (in
nats) is ``entropy``; with both, the latter, if it keeps the limit. A target that no exponent meets is an error. The budget is given in tokens, or is the least at which every source is read
whole at least once, so that no document is lost.

Realisation. A source's quota is its weight of the budget: some whole passes and a rest. Its documents are dealt into
blocks by a hash of their id, ``BLOCK_TOKENS`` each or 1/``BLOCKS`` of the source if that is more. Every pass takes the
blocks in an order of its own; the rest takes blocks while they fit, and of the next block its documents, in hash
order, while they fit. So quotas are never exceeded. ``at`` places a block between 0 and 1 in its source's reading;
the mix in that order has the target weights all along.

Only a row per source comes to the driver; more than ``SOURCES`` of them is an error. Blocks spread a source, however
large, over many keys, and token sums are combined before they're shuffled.

A null source is a source of its own. Null and empty texts have no tokens and go along with their block; a source
without tokens is read once. Rows that repeat an id go the same way together, as does a null id. No rows: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.llm.scratch import Scratch
from seekframe.tables import table

BLOCK_TOKENS, BLOCKS = 1_000_000, 10_000
SOURCES = 100_000
REPEATS = 2.0
STEEPEST, CLOSE = 16.0, 1e-6
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised powers of the shares of sources with tokens."""
    top = math.log(max(tokens.values()))
    raised = {s: math.exp(exponent * (math.log(t) - top)) for s, t in tokens.items()}
    total = math.fsum(raised.values())
    return {s: r / total for s, r in raised.items()}


def entropy_of(mix: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in mix.values() if w > 0)


def covering(tokens: dict[str, int], mix: dict[str, float]) -> float:
    """The least budget at which every source is read whole."""
    return max(t / mix[s] for s, t in tokens.items())


def most_repeats(tokens: dict[str, int], mix: dict[str, float], budget: float) -> float:
    return max(mix[s] * budget / t for s, t in tokens.items())


def bisected(fits, low: float, high: float, rounds: int = 60) -> float:
    """The least number from ``low`` to ``high`` that fits, where all larger ones do; ``high`` if none does."""
    if fits(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def exponent(tokens: dict[str, int], budget: float | None, repeats: float | None = REPEATS, entropy: float | None = None) -> float:
    """The exponent that meets the targets; 1 without targets."""
    found = [] if repeats is not None or entropy is not None else [1.0]
    if repeats is not None:
        at = lambda a: most_repeats(tokens, m := weights(tokens, a), covering(tokens, m) if budget is None else budget)
        found.append(bisected(lambda a: at(a) <= repeats, 0.0, 1.0))
    if entropy is not None:
        least = bisected(lambda a: entropy_of(weights(tokens, a)) <= entropy, 0.0, STEEPEST)
        if abs(entropy_of(weights(tokens, least)) - entropy) > CLOSE:
            raise ValueError(f"no exponent up to {STEEPEST} gives these sources an entropy of {entropy}")
        if repeats is not None and found[0] > least + CLOSE:
            raise ValueError(f"an entropy of {entropy} and at most {repeats} readings can't both be had")
        found.append(least)
    return max(found)


def quotas(tokens: dict[str, int], budget: float | None = None, repeats: float | None = REPEATS, entropy: float | None = None) -> dict[str, int]:
    """Tokens to read of each source."""
    some = {s: t for s, t in tokens.items() if t > 0}
    if not some:
        return {}
    mix = weights(some, exponent(some, budget, repeats, entropy))
    if budget is None:
        whole = covering(some, mix)
        return {s: max(t, int(mix[s] * whole + 1e-6)) for s, t in some.items()}
    return {s: int(mix[s] * budget) for s in some}


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix(docs: DataFrame, budget: float | None = None, repeats: float | None = REPEATS, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, *carry, pass, block, at): a row for each time that a document is read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    counted = docs.select(_key(F.col(source_col)).alias("k"), F.col(id_col).alias("i"), F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("t"))
    rows = scratch.keep(counted)
    totals = rows.groupBy("k").agg(F.sum("t").alias("t")).limit(SOURCES + 1).collect()
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    tokens = {r["k"]: r["t"] for r in totals}
    quota = quotas(tokens, budget, repeats, entropy)
    plan = [(k, t, quota.get(k, 0), max(1, min(BLOCKS, -(-t // block_tokens))), quota[k] // t if t else 1, quota[k] % t if t else 0) for k, t in tokens.items()]
    # at most SOURCES rows: small enough for every task, so that no source's rows meet for it
    plan = F.broadcast(spark.createDataFrame(plan, "k string, total long, quota long, blocks long, whole long, rest long"))
    deal = F.pmod(F.xxhash64(F.lit(SEED), "i"), F.col("blocks")).alias("b")
    turn = F.xxhash64(F.lit(SEED + 1), "pass", "i")

    dealt = rows.join(plan, "k")
    sums = dealt.groupBy("k", deal).agg(F.sum("t").alias("t")).join(plan, "k")
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1)))
    sums = sums.where("whole > 0 or rest > 0").withColumn("pass", passes)
    order = W.partitionBy("k", "pass").orderBy(F.xxhash64(F.lit(SEED + 2), "pass", "k", "b"), "b")
    before = F.sum("t").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("t")
    placed = sums.withColumn("before", before)
    placed = placed.where((F.col("pass") < F.col("whole")) | (F.col("before") < F.col("rest")))
    fits = (F.col("pass") < F.col("whole")) | (F.col("before") + F.col("t") <= F.col("rest"))
    at = F.when(F.col("quota") > 0, (F.col("pass") * F.col("total") + F.col("before")) / F.col("quota")).otherwise(0.0)
    placed = scratch.keep(placed.select("k", "b", "pass", "before", "rest", fits.alias("fits"), at.alias("at")))

    # of a source's one block that fits in part: the documents, in hash order, that do
    cut = dealt.select("k", deal, "i", "t").join(placed.where(~F.col("fits")), ["k", "b"]).select("k", "b", "pass", turn.alias("turn"), "t", (F.col("rest") - F.col("before")).alias("room"))
    cut = cut.groupBy("k", "b", "pass", "turn", "room").agg(F.sum("t").alias("t"))
    run = F.sum("t").over(W.partitionBy("k", "b", "pass").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = cut.withColumn("run", run).where("run <= room").groupBy("k", "b", "pass").agg(F.max("turn").alias("last"))
    blocks = scratch.keep(placed.join(cut, ["k", "b", "pass"], "left").where("fits or last is not null").select("k", "b", "pass", "at", F.when(~F.col("fits"), F.col("last")).alias("last")))

    row = docs.select(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.struct(*carry).alias("c") if carry else F.lit(0).alias("c")).withColumn("k", _key(F.col("s")))
    read = row.join(F.broadcast(plan.select("k", "blocks")), "k").withColumn("b", deal).join(blocks, ["k", "b"]).where(F.col("last").isNull() | (turn <= F.col("last")))
    carried = ["c.*"] if carry else []
    return read.select(F.col("i").alias(id_col), F.col("s").alias(source_col), *carried, F.col("pass"), F.col("b").alias("block"), "at")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's readings when sources are mixed with at most two readings of any."""
    read = mix(table(spark, sf_dir, "documents"))
    return read.select("doc_id", "source", "pass", "block", F.round("at", 9).alias("at"))

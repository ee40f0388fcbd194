"""Selecting under a token budget: greedy, with truncation, and fairly across projects.

Any number of items can compete. What is left of a budget only falls, so of items of the same size only the first
``budget / size`` can be taken: where one doesn't fit, no later one of its size does. The folds read those items alone,
whose number depends on the budget and not on the input, and take what they would take from all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.functions.limits import PROJECTS_MOST
from seekframe.functions.text import token_estimate
from seekframe.kept import keep

LEAST = 24
MARK = "... [truncated]"
CHARACTERS = 3.5  # of a token
MARK_TOKENS = math.ceil(len(MARK) / CHARACTERS)
LINE_END = r"\r\n|[\n\x0B\f\r\x85\u2028\u2029]"
#: What counts as white space.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PARTS = 32
#: Places in a list that are summed together.
PLACES = 4096


def first(rows: DataFrame, keys: tuple[str, ...], order: list[str], most: Column) -> DataFrame:
    """Each key's first ``most`` rows; parts of a key are cut before they meet."""
    by = [F.col(o) for o in order]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(_PARTS)))
    cut = dealt.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*by))).where(F.col("_n") <= most)
    return cut.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col("_n") <= most).drop("_part", "_n")


def ordered(keys: tuple[str, ...], row: list[str], order: list[Column], rows: DataFrame) -> DataFrame:
    """(*keys, items): each key's rows as one array in order. A key's rows are a result list, bounded by its limit."""
    items = F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)], *row)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(items)).alias("items"))


def greedy(rows: DataFrame, budget: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*keys, path, start_line, tokens, place): fragments by score while they fit; one that doesn't is passed over.

    An item takes at most half the budget. ``rows``: (*keys, path, start_line, end_line, tokens, score).
    """
    most = max(LEAST, budget // 2)
    order = ["o", "path", "start_line", "end_line"]
    named = rows.select(*keys, (-F.round("score", 9)).alias("o"), "path", "start_line", "end_line", "tokens")
    can = first(named.where(F.col("tokens").between(1, most)), (*keys, "tokens"), order, F.floor(F.lit(budget) / F.col("tokens")))
    lists = ordered(keys, ["path", "start_line", "end_line", "tokens"], [F.col(o) for o in order], can)
    start = F.struct(F.lit(budget).alias("left"), F.filter("items", lambda x: F.lit(False)).alias("took"))

    def step(a: Column, x: Column) -> Column:
        fits = x["tokens"] <= a["left"]
        return F.struct(F.when(fits, a["left"] - x["tokens"]).otherwise(a["left"]).cast("int").alias("left"), F.when(fits, F.concat(a["took"], F.array(x))).otherwise(a["took"]).alias("took"))

    folded = lists.select(*keys, F.aggregate("items", start, step, lambda a: a["took"]).alias("took"))
    took = folded.select(*keys, F.explode("took").alias("t")).select(*keys, F.col("t.o0").alias("o"), *[f"t.{c}" for c in (*order[1:], "tokens")])
    # what has no tokens always fits
    every = took.unionByName(named.where("tokens = 0"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return every.select(*keys, "path", F.col("start_line").cast("int").alias("start_line"), F.col("tokens").cast("int").alias("tokens"), place.alias("place"))


def split(tokens: Column) -> list[Column]:
    """A context budget's parts, as limits.budget_split(): instructions, skills, history and what is left for tasks."""
    share = lambda least, most, part: F.least(F.lit(most), F.greatest(F.lit(least), F.floor(part)))
    told = F.least(tokens, share(24, 600, tokens / 4))
    skills = F.least(tokens - told, share(64, 2000, tokens / 5))
    past = F.when(tokens >= 500, F.least(tokens - told - skills, share(64, 500, tokens * 15 / 100))).otherwise(0)
    return [c.cast("int").alias(n) for n, c in (("instructions", told), ("skills", skills), ("history", past), ("tasks", tokens - told - skills - past))]


def room(tokens: Column) -> Column:
    """The characters that so many tokens hold."""
    return F.floor(tokens * F.lit(CHARACTERS)).cast("int")


def shortened(head: Column, size: Column, tokens: Column) -> Column:
    """struct<kept, lines, marked, tokens>: what is left of a text when it may take ``tokens``; null tokens if nothing is.

    ``head``: the text with one kind of line end, cut to what can be kept at most; ``size``: its whole length. All of it if it
    fits with the mark; else the whole lines that fit before the mark; else the characters of the first line that do.
    ``kept`` counts characters. Line ends say where lines end, so no line is tried one after another.
    """
    before = room(tokens) - len(MARK) - 1
    reach = F.substring(head, F.lit(1), F.greatest(F.lit(0), before + 1))
    last = F.length(reach) - F.length(F.substring_index(reach, "\n", -1)) - 1  # where the last line end in reach stands
    count = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    told = lambda kept, lines, marked, tokens: F.struct(kept.cast("int").alias("kept"), lines.cast("int").alias("lines"), F.lit(marked).alias("marked"), tokens.cast("int").alias("tokens"))
    none = told(F.lit(0), F.lit(0), True, F.lit(None))
    cost = lambda characters: F.ceil(characters / F.lit(CHARACTERS))
    whole = told(size, count(head) + 1, False, F.greatest(F.lit(1), cost(size)))
    lines = told(last, count(reach), True, cost(last + len(MARK) + 1))
    letters = told(before, F.lit(1), True, cost(before + len(MARK) + 1))
    return F.when(before < 0, none).when(size <= before, whole).when(reach.contains("\n"), lines).otherwise(letters)


def _prepared(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` with o, need, blank and the beginning of the content that can matter."""
    content = F.coalesce("content", F.lit(""))
    longest = 2 * int(CHARACTERS * most) + 2  # a line's end may have two characters
    return rows.select(
        key, "path", "start_line", "end_line", (-F.round("score", 9)).alias("o"), token_estimate(content).alias("need"),
        F.substring(content, 1, longest).alias("content"), (~content.rlike(f"[^{SPACE}]")).alias("blank"),
    )


def greedy_truncating(rows: DataFrame, budget: int, key: str = "query_id", texts: bool = False) -> DataFrame:
    """(key, path, start_line, end_line, tokens, cut): as greedy(), but what doesn't fit is shortened if 24 tokens are left.

    With ``texts`` also each item's content, and its place among those with any token.

    ``rows``: (key, path, start_line, end_line, score, content). A text of white space alone counts only while it fits
    whole or with a mark. The fold sees, of items below 24 tokens, those that can be taken; of longer ones as many
    as use up the budget, since each costs the mark's tokens at least; and long blank ones.
    """
    most = max(LEAST, budget // 2)
    order = ["o", "path", "start_line", "end_line"]
    needed = _prepared(rows, key, most)
    short = first(needed.where(F.col("need").between(1, LEAST - 1)), (key, "need"), order, F.floor(F.lit(budget) / F.col("need")))
    long = needed.where((F.col("need") >= LEAST) & ~F.col("blank"))
    # a literal limit: each task cuts its own rows before texts are shuffled
    long = long.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("n") <= budget // MARK_TOKENS + 1).drop("n")
    can = short.unionByName(long).unionByName(needed.where((F.col("need") >= LEAST) & F.col("blank")))
    plain = F.regexp_replace("content", LINE_END, "\n")
    can = can.withColumn("head", F.substring(plain, 1, int(CHARACTERS * most) + 1)).withColumn("size", F.length(plain))
    fields = ["path", "start_line", "end_line", "need", "head", "size", "blank", *(["content"] if texts else [])]
    lists = ordered((key,), fields, [F.col(o) for o in order], can)
    entry = f"array<struct<path:string,start_line:int,end_line:int,tokens:int,cut:boolean{',content:string' if texts else ''}>>"
    start = F.struct(F.lit(budget).alias("left"), F.array().cast(entry).alias("took"))

    def step(a: Column, x: Column) -> Column:
        allowed = F.least(a["left"], F.lit(most))
        fits = x["need"] <= allowed
        part = shortened(x["head"], x["size"], allowed)
        able = fits | ((allowed >= LEAST) & part["tokens"].isNotNull() & (part["marked"] | ~x["blank"]))
        tokens = F.when(fits, x["need"]).otherwise(part["tokens"])
        end = F.when(fits, x["end_line"]).otherwise(F.least(x["end_line"], x["start_line"] + F.greatest(F.lit(0), part["lines"] - 1)))
        left = F.when(part["marked"], F.concat(F.substring(x["head"], F.lit(1), part["kept"]), F.lit("\n" + MARK))).otherwise(x["head"])
        held = [F.when(fits, x["content"]).otherwise(left).alias("content")] if texts else []
        taken = F.struct(x["path"].alias("path"), x["start_line"].cast("int").alias("start_line"), end.cast("int").alias("end_line"), tokens.cast("int").alias("tokens"), (~fits).alias("cut"), *held)
        return F.struct(F.when(able, a["left"] - tokens).otherwise(a["left"]).cast("int").alias("left"), F.when(able, F.concat(a["took"], F.array(taken))).otherwise(a["took"]).alias("took"))

    folded = lists.select(key, F.posexplode(F.aggregate("items", start, step, lambda a: a["took"])).alias("n", "t"))
    folded = folded.select(key, "t.*", *([(F.col("n") + 1).alias("place")] if texts else []))
    # what has no tokens always fits
    nothing = needed.where("need = 0").select(key, "path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.lit(0).alias("tokens"), F.lit(False).alias("cut"))
    return folded.unionByName(nothing, allowMissingColumns=True)


def same_content(type: Column, content: Column) -> Column:
    """A digest that items share if type and content (white space aside) are equal."""
    words = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), f"[{SPACE}]+", " "))
    return F.sha2(F.concat(F.coalesce(type, F.lit("")), F.lit("\0"), words), 256)


def federated(rows: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """(key, project, path, tokens, refill, place): a fair floor for every project, then what's left in turn.

    ``rows``: (key, project, project_place, item_place, type, path, content, tokens, fair), each project's items in order;
    project_place counts from 0, up to a hundred projects. Items are offered in rounds, each project's first, each one's second
    and so on. A project takes from its fair part until one of its items doesn't fit there or in the budget; that and all its
    later ones wait. Then those that wait are offered once more, in the same order, to what's left of the budget. Of items
    with equal type and content (white space aside) the first taken counts. ``rows`` may have same_content() as ``same`` instead
    of type and content.

    Two folds, each over what can matter. The first sees a project's items up to the place at which it is closed for certain: the
    first item above its fair part, or the one at which contents that nothing before it can have taken exceed that part. Of items
    that repeat one of their own project they may only close it, so between two others one of each size stays, the last.
    Then those that wait, their contents not taken yet, are cut to what the rest of the budget can hold of each size. So both folds
    follow the budget and the number of projects, not the items.
    """
    same = F.col("same") if "same" in rows.columns else same_content(F.col("type"), F.col("content"))
    columns = (key, "project", "project_place", "item_place", "path", "tokens", "fair")
    items = keep(rows.select(*columns, same.alias("same")), "items")
    opened = keep(_opened(_offered(items, budget, key), budget, key), "opened")
    took = opened.select(key, F.posexplode("took").alias("n", "t")).select(key, "n", F.lit(False).alias("refill"), "t.*")
    return _numbered(took.unionByName(_refilled(items, opened, took, key, budget)), key)


def _offered(items: DataFrame, budget: int, key: str) -> DataFrame:
    """The items that the first fold has to see."""
    own = (key, "project_place")
    rest = F.struct("item_place", "project", "path", "fair")
    takers = keep(items.groupBy(*own, "same", "tokens").agg(F.min(rest).alias("x")).select(*own, "same", "tokens", "x.*"), "takers")
    cut = takers.where("tokens > fair").groupBy(*own).agg(F.min("item_place").alias("last"))
    before = None
    while True:
        inside = takers.join(cut, list(own), "left").where("last is null or item_place <= last").drop("last")
        n = inside.count()
        if n == before or n <= (budget if before is None else 4 * (budget + PROJECTS_MOST)):
            break
        before = n
        firsts = inside.groupBy(key, "same").agg(F.min(F.struct("item_place", "project_place")).alias("f")).select(key, "same", "f.*")
        new = inside.join(firsts, [key, "same", "item_place", "project_place"], "left_semi")
        run = _running(new, own, F.col("tokens"))
        over = run.where("run > fair").groupBy(*own).agg(F.min("item_place").alias("over"))
        cut = cut.join(over, list(own), "full_outer").select(*own, F.least("last", "over").alias("last"))
        cut = keep(cut, "cut")
    inside = keep(inside, "inside")
    here = items.join(cut, list(own), "left").where("last is null or item_place <= last").drop("last")
    again = here.join(inside.select(*own, "item_place"), [*own, "item_place"], "left_anti")
    both = inside.select(*own, "item_place", F.lit(1).alias("new"), "tokens").unionByName(again.select(*own, "item_place", F.lit(0).alias("new"), "tokens"))
    last = _running(both, own, F.col("new")).where("new = 0").groupBy(*own, "run", "tokens").agg(F.max("item_place").alias("item_place"))
    return inside.unionByName(again.join(last.select(*own, "item_place"), [*own, "item_place"], "left_semi").select(inside.columns))


def _running(rows: DataFrame, keys: tuple[str, ...], amount: Column) -> DataFrame:
    """``rows`` with ``run``, the sum of ``amount`` up to and with each by item_place; counted in blocks of places."""
    dealt = rows.withColumn("_amount", amount.cast("long")).withColumn("_block", F.expr(f"item_place div {PLACES}"))
    sums = dealt.groupBy(*keys, "_block").agg(F.sum("_amount").alias("_sum"))
    earlier = F.sum("_sum").over(W.partitionBy(*keys).orderBy("_block")) - F.col("_sum")
    own = F.sum("_amount").over(W.partitionBy(*keys, "_block").orderBy("item_place"))
    dealt = dealt.withColumn("_own", own).join(sums.select(*keys, "_block", earlier.alias("_earlier")), [*keys, "_block"])
    return dealt.withColumn("run", F.col("_own") + F.col("_earlier")).drop("_amount", "_block", "_own", "_earlier")


_ENTRY = "array<struct<project:string,path:string,tokens:int,same:string>>"


def _told(x: Column) -> Column:
    return F.array(F.struct(x["project"].alias("project"), x["path"].alias("path"), x["tokens"].cast("int").alias("tokens"), x["same"].alias("same")))


def _known(a: Column, x: Column) -> Column:
    return F.exists(a["took"], lambda t: t["same"] == x["same"])


def _lists(rows: DataFrame, key: str, extra: list[str]) -> DataFrame:
    rows = rows.withColumn("tokens", F.col("tokens").cast("long")).withColumn("project_place", F.col("project_place").cast("int"))
    return ordered((key,), ["project", "project_place", "item_place", "path", "tokens", "same", *extra], [F.col("item_place"), F.col("project_place")], rows)


def _opened(rows: DataFrame, budget: int, key: str) -> DataFrame:
    """(key, spent, took, closed): what projects take of their fair parts, and by project the item that closed it."""
    lists = _lists(rows.withColumn("fair", F.col("fair").cast("long")).withColumn("item_place", F.col("item_place").cast("long")), key, ["fair"])
    places = F.array_max(F.transform("items", lambda x: x["project_place"])) + 1
    places = F.when(places <= PROJECTS_MOST, places).otherwise(F.raise_error(F.lit(f"more than {PROJECTS_MOST} projects")).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array_repeat(F.lit(0).cast("long"), places).alias("used"), F.array_repeat(F.lit(None).cast("long"), places).alias("closed"), F.array().cast(_ENTRY).alias("took"))

    def offer(a: Column, x: Column) -> Column:
        shut = F.get(a["closed"], x["project_place"]).isNotNull()
        fits = (F.get(a["used"], x["project_place"]) + x["tokens"] <= x["fair"]) & (a["spent"] + x["tokens"] <= budget)
        takes = ~shut & fits & ~_known(a, x)
        closes = ~shut & ~fits
        put = lambda values, when, value: F.when(when, F.transform(values, lambda v, i: F.when(i == x["project_place"], value(v)).otherwise(v))).otherwise(values)
        return F.struct(
            F.when(takes, a["spent"] + x["tokens"]).otherwise(a["spent"]).alias("spent"), put(a["used"], takes, lambda v: v + x["tokens"]).alias("used"),
            put(a["closed"], closes, lambda v: x["item_place"]).alias("closed"), F.when(takes, F.concat(a["took"], _told(x))).otherwise(a["took"]).alias("took"),
        )

    return lists.select(key, F.aggregate("items", start, offer).alias("a")).select(key, "a.spent", "a.took", "a.closed")


def _refilled(items: DataFrame, opened: DataFrame, took: DataFrame, key: str, budget: int) -> DataFrame:
    """What is taken of those that wait, in their order."""
    closed = opened.select(key, F.posexplode("closed").alias("project_place", "at")).where("at is not null")
    waits = items.join(closed, [key, "project_place"]).where("item_place >= at").join(took.select(key, "same"), [key, "same"], "left_anti")
    once = waits.groupBy(key, "same", "tokens").agg(F.min(F.struct("item_place", "project_place", "project", "path")).alias("x")).select(key, "same", "tokens", "x.*")
    once = once.join(opened.select(key, (F.lit(budget) - F.col("spent")).alias("left")), key).where("tokens <= left")
    # of one size at most so many are taken; as many more as contents of several sizes can be taken in another one
    sizes = once.groupBy(key, "same").agg(F.count("*").alias("sizes"))
    once = once.join(sizes, [key, "same"]).withColumn("plain", F.col("sizes") == 1)
    order, size = ["item_place", "project_place"], F.greatest("tokens", F.lit(1))
    some = first(once.where("plain and tokens > 0"), (key, "tokens"), order, F.floor(F.col("left") / size))
    several = first(once.where("not plain"), (key, "tokens"), order, F.floor(F.col("left") / size) + F.col("left") + 1)
    can = some.unionByName(several).unionByName(once.where("plain and tokens <= 0"))
    start = F.struct(F.col("left").alias("left"), F.array().cast(_ENTRY).alias("took"))

    def again(a: Column, x: Column) -> Column:
        takes = (x["tokens"] <= a["left"]) & ~_known(a, x)
        return F.struct(F.when(takes, a["left"] - x["tokens"]).otherwise(a["left"]).alias("left"), F.when(takes, F.concat(a["took"], _told(x))).otherwise(a["took"]).alias("took"))

    lists = _lists(can, key, []).join(opened.select(key, (F.lit(budget) - F.col("spent")).alias("left")), key)
    taken = lists.select(key, F.posexplode(F.aggregate("items", start, again)["took"]).alias("n", "t"))
    return taken.select(key, "n", F.lit(True).alias("refill"), "t.*")


def _numbered(took: DataFrame, key: str) -> DataFrame:
    """What was taken with its place; as many rows as the budget allows."""
    place = F.row_number().over(W.partitionBy(key).orderBy("refill", "n"))
    return took.select(key, "project", "path", "tokens", "refill", place.alias("place"))


def shares(merged: DataFrame, scope: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, project, tokens, items, starved) of every project in ``scope`` (*keys, project); starved ones have no item."""
    own = merged.groupBy(*keys, "project").agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("items"))
    none = F.lit(0).cast("long")
    out = scope.select(*keys, "project").distinct().join(own, [*keys, "project"], "left")
    return out.select(*keys, "project", F.coalesce("tokens", none).alias("tokens"), F.coalesce("items", none).alias("items"), F.col("items").isNull().alias("starved"))


def totals(selected: DataFrame, keys: tuple[str, ...] = ("part",)) -> DataFrame:
    """(*keys, tokens, items, truncated) of what was selected: (*keys, tokens, cut)."""
    return selected.groupBy(*keys).agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("items"), F.count_if("cut").alias("truncated"))


def summary(available: DataFrame, selected: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, available, selected, items, reduction): totals of a bundle; reduction is max(0, 1 - selected / available)."""
    a = available.groupBy(key).agg(F.sum("tokens").alias("available"))
    s = selected.groupBy(key).agg(F.sum("tokens").alias("selected"), F.count("*").alias("items"))
    out = a.join(s, key, "left").fillna(0, ["selected", "items"])
    share = F.when(F.col("available") > 0, F.greatest(F.lit(0.0), 1 - F.col("selected") / F.col("available"))).otherwise(0.0)
    return out.withColumn("reduction", share)

"""BM25 over several fields, for many queries in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.functions.text import all_terms, identifier_tokens, path_score, tokens
from seekframe.kept import keep

# Field boosts and the similarity's constants.
BOOSTS = {"symbol_name": 5.0, "qualified_name": 4.0, "path": 3.0, "code_terms": 2.0, "content": 1.0}
K1, B = 1.2, 0.75
#: Files of a window; postings up to which nothing is left out; postings of the first windows, as many times the limit; windows named in a filter.
WINDOW_FILES, WHOLE, FIRST, NAMED = 128, 1_000_000, 8, 1000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, needed): each query's distinct tokens; of two or more, a document needs two."""
    words = F.array_distinct(tokens(F.col("query")))
    return queries.select("query_id", F.explode(words).alias("term"), F.when(F.size(words) < 2, 1).otherwise(2).alias("needed"))


def field_tokens(files: DataFrame, wanted: Column | None) -> DataFrame:
    """(project, path, field, size, hits): field lengths and the wanted tokens in them, all if None.

    Texts are cut down to the queries' terms before anything is exploded or shuffled.
    """
    fields = {"path": tokens(F.col("path")), "code_terms": identifier_tokens(F.concat_ws(" ", "path", "content")), "content": tokens(F.col("content"))}
    if "symbol_names" in files.columns:
        fields |= {"symbol_name": tokens(F.array_join("symbol_names", " ")), "qualified_name": tokens(F.array_join("qualified_names", " "))}
    each = F.array(*[F.struct(F.lit(name).alias("field"), words.alias("words")) for name, words in fields.items()])
    rows = files.select("project", "path", F.explode(each).alias("f")).select("project", "path", "f.field", "f.words")
    rows = rows.where(F.size("words") > 0)
    hits = F.col("words") if wanted is None else F.filter("words", lambda w: F.array_contains(wanted, w))
    return rows.select("project", "path", "field", F.size("words").cast("long").alias("size"), hits.alias("hits"))


def asked(queries: DataFrame) -> list[str]:
    """The distinct terms of some queries, for a literal filter: as many as a caller can write."""
    return sorted({r["term"] for r in query_terms(queries).select("term").collect()})


def scores(files: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, project, path, score) of every file that has enough of a query's terms, without an index.

    Statistics are per project and field. Texts are read and taken apart once; what's left of them, lengths and the
    queries' terms, is kept for statistics and postings.
    """
    wanted = asked(queries)
    return search(*taken_apart(files, wanted), queries, wanted)


def named(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``files`` with the names of their symbols, the other two fields of an index."""
    names = symbols.groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("symbol_names"), F.array_sort(F.collect_list("qualified")).alias("qualified_names"))
    empty = F.array().cast("array<string>")
    both = files.join(names, "path", "left")
    return both.withColumn("symbol_names", F.coalesce("symbol_names", empty)).withColumn("qualified_names", F.coalesce("qualified_names", empty))


def taken_apart(files: DataFrame, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(fields, postings) of some files: (project, path, field, size) and (project, path, field, size, term, tf).

    A field's terms are counted where its text is, sorted and taken apart into runs, so that nothing is shuffled. Of the
    ``wanted`` terms only, what's left of the texts is kept, so that they are read and taken apart once for both.
    """
    rows = field_tokens(files, None) if wanted is None else keep(field_tokens(files, F.array(*[F.lit(t) for t in wanted]).cast("array<string>")), "lexical")
    # of sorted words, where each run of the same one starts
    first = lambda w: F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
    runs = rows.withColumn("hits", F.array_sort("hits")).withColumn("starts", first(F.col("hits")))
    counted = F.transform("starts", lambda i, n: F.struct(F.get("hits", i).alias("term"), (F.coalesce(F.get("starts", n + 1), F.size("hits")) - i).cast("long").alias("tf")))
    each = runs.select("project", "path", "field", "size", F.explode(counted).alias("c")).select("project", "path", "field", "size", "c.term", "c.tf")
    return rows.drop("hits"), each


def windows_for(files: int) -> int:
    """A power of two: the windows that so many files are dealt into."""
    return 1 << max(0, (files // WINDOW_FILES).bit_length())


def in_windows(postings: DataFrame, windows: int) -> DataFrame:
    """``postings`` with the window that their file is dealt into: a file's postings all lie in one."""
    return postings.withColumn("window", F.pmod(F.xxhash64("path"), F.lit(windows)).cast("int"))


def blocks(postings: DataFrame) -> DataFrame:
    """(project, field, term, window, n, edge): what no posting of a term in a window can exceed.

    ``edge``: the pairs of length and frequency that no other pair of the window beats in both. Whatever the field's mean
    length comes to be, one of them has the greatest part.
    """
    own = F.array_sort(F.collect_list(F.struct("size", (-F.col("tf")).alias("tf"))))
    step = lambda a, x: F.when((F.size(a) == 0) | (x["tf"] < F.element_at(a, -1)["tf"]), F.concat(a, F.array(x))).otherwise(a)
    pairs = postings.groupBy("project", "field", "term", "window").agg(F.count("*").alias("n"), own.alias("own"))
    edge = F.when(F.size("own") == 1, F.col("own")).otherwise(F.aggregate("own", F.filter("own", lambda x: F.lit(False)), step))
    return pairs.select("project", "field", "term", "window", "n", F.transform(edge, lambda x: F.struct(x["size"].alias("size"), (-x["tf"]).alias("tf"))).alias("edge"))


def stored(postings: DataFrame) -> DataFrame:
    """``postings`` or blocks as they are best written: ranges of terms, each in order, so that a query's terms prune to few row groups.

    A frequent term's windows are dealt into several ranges.
    """
    order = ["term", *[c for c in ("window",) if c in postings.columns]]
    return postings.repartitionByRange(*order).sortWithinPartitions(*order)


def build(files: DataFrame, windows: int = 1, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(fields, postings): an index to be stored and searched often, of all terms or of the ``wanted`` ones."""
    fields, postings = taken_apart(files, wanted)
    return fields, stored(in_windows(postings, windows))


def _weight(fields: DataFrame, found: DataFrame) -> DataFrame:
    """(project, field, term, weight, mean) of terms that are in ``df`` files each: boost times rarity, and the field's mean length."""
    # one row per project and field, and per project, field and term of the queries: small by construction
    stats = fields.groupBy("project", "field").agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    boost = F.element_at(F.create_map(*[x for k, v in BOOSTS.items() for x in (F.lit(k), F.lit(v))]), F.col("field"))
    return found.join(stats, ["project", "field"]).select("project", "field", "term", (boost * idf).alias("weight"), "mean")


def _part(tf: Column, size: Column) -> Column:
    return F.col("weight") * tf / (tf + K1 * (1 - B + B * size / F.col("mean")))


def search(fields: DataFrame, postings: DataFrame, queries: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(query_id, project, path, score) from an index of at least the queries' terms."""
    posting = postings.where(F.col("term").isin(asked(queries) if wanted is None else wanted))
    found = posting.groupBy("project", "field", "term").agg(F.count("*").alias("df"))
    return _summed(posting, _weight(fields, found), query_terms(queries))


def _summed(posting: DataFrame, weights: DataFrame, terms_of: DataFrame, keys: tuple[str, ...] = ("term",)) -> DataFrame:
    met = posting.join(weights, ["project", "field", "term"]).withColumn("part", _part(F.col("tf"), F.col("size"))).join(terms_of, list(keys))
    summed = met.groupBy("query_id", "project", "path").agg(F.sum("part").alias("score"), F.count_distinct("term").alias("terms"), F.max("needed").alias("needed"))
    return summed.where("terms >= needed").select("query_id", "project", "path", "score")


def search_best(fields: DataFrame, postings: DataFrame, heads: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Of search()'s rows at least the best ``limit`` of each query and project, from the windows that can hold them.

    ``postings``: in_windows(), ``heads``: their blocks(). A window's bound is the sum of what its blocks can give at most. The
    windows of the highest bounds are scored first; then those whose bound reaches the limit-th score found. Others
    hold nothing that belongs to the best, and aren't read. With fewer postings than ``WHOLE`` all are read in one go.
    """
    wanted, terms_of = asked(queries), query_terms(queries)
    head = heads.where(F.col("term").isin(wanted))
    if (head.agg(F.sum("n")).first()[0] or 0) <= WHOLE:
        return search(fields, postings, queries, wanted)
    head = keep(head, "blocks")
    posting = postings.where(F.col("term").isin(wanted))
    weights = keep(_weight(fields, head.groupBy("project", "field", "term").agg(F.sum("n").alias("df"))), "weights")
    each = head.join(weights, ["project", "field", "term"]).withColumn("part", F.array_max(F.transform("edge", lambda x: _part(x["tf"], x["size"])))).join(terms_of, "term")
    # a file lies in one of a window's blocks of a field and term, though there may be several
    each = each.groupBy("query_id", "project", "window", "field", "term").agg(F.max("part").alias("part"), F.sum("n").alias("n"), F.max("needed").alias("needed"))
    bound = each.groupBy("query_id", "project", "window").agg(F.sum("part").alias("bound"), F.sum("n").alias("n"), F.count_distinct("term").alias("terms"), F.max("needed").alias("needed"))
    before = F.sum("n").over(W.partitionBy("query_id", "project").orderBy(F.desc("bound"), "window").rowsBetween(W.unboundedPreceding, -1))
    bound = keep(bound.where("terms >= needed").withColumn("before", F.coalesce(before, F.lit(0))), "bounds")

    def scored(of: DataFrame) -> DataFrame:
        named = [r[0] for r in of.select("window").distinct().limit(NAMED + 1).collect()]
        some = posting.where(F.col("window").isin(named)) if len(named) <= NAMED else posting
        pairs = terms_of.join(of.select("query_id", "project", "window"), "query_id")
        return _summed(some, weights, pairs, ("project", "window", "term"))

    first = bound.where(F.col("before") < FIRST * limit)
    begun = keep(top(scored(first), limit).drop("rank"), "begun")
    least = begun.groupBy("query_id", "project").agg(F.when(F.count("*") >= limit, F.min("score")).alias("least"))
    rest = bound.where(F.col("before") >= FIRST * limit).join(least, ["query_id", "project"], "left")
    rest = keep(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-8)), "rest")
    return begun if rest.isEmpty() else begun.unionByName(scored(rest))


def top(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of each query and project, ties by path, with their rank."""
    order = W.partitionBy("query_id", "project").orderBy(F.desc(F.round("score", 9)), "path")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def normalised(hits: DataFrame) -> DataFrame:
    """``hits`` with ``lexical``, the score over the best of its query and project."""
    best = F.max("score").over(W.partitionBy("query_id", "project"))
    return hits.withColumn("lexical", F.when(best > 0, F.col("score") / best).otherwise(0.0))


def candidates(hits: DataFrame, queries: DataFrame, limit: int, eligible: DataFrame | None = None) -> DataFrame:
    """(query_id, project, path, lexical, path_signal) of the lexical strategy.

    ``hits``: of scores() or search(). With ``eligible`` (path), of the best 2 x ``limit`` those count that are.
    """
    best = top(hits, limit) if eligible is None else top(top(hits, 2 * limit).drop("rank").join(eligible.select("path").distinct(), "path", "left_semi"), limit)
    signal = path_score(F.col("path"), all_terms(F.col("query")))
    return normalised(best).join(queries, "query_id").select("query_id", "project", "path", "lexical", signal.alias("path_signal"))

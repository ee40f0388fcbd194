"""Index maintenance: what changed, fingerprints, providers' rows, and bringing a project's tables up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekframe.kept import drop, keep
from seekframe.operators import lexical, symbol_index
from seekframe.operators.store import Change, Snapshots, View, buckets_for

BUILTIN = "builtin"
STATUSES = ("NOT_INDEXED", "INDEXING", "READY", "FAILED")


def delta(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, status): NEW, CHANGED, UNCHANGED or REMOVED, by content hash. Both sides: (path, hash)."""
    s, n = stored.select("path", F.col("hash").alias("old")), scanned.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "REMOVED").when(F.col("old") == F.col("new"), "UNCHANGED").otherwise("CHANGED")
    return s.join(n, "path", "full_outer").select("path", status.alias("status"))


def fingerprint(files: DataFrame, keys: tuple[str, ...] = ("project",)) -> DataFrame:
    """(*keys, fingerprint): SHA-256 over the files, each with its path, hash, language and category.

    Files are dealt by the first four hexadecimal digits of their path's SHA-256. A digest is made of each deal's lines in path
    order, one of the digests with the same first two digits in order, and one of those: no row holds more than a
    deal's lines, one in 65,536 of a key's, or 256 digests.
    """
    line = F.concat_ws("\0", "path", "hash", "language", "category", F.lit("\n"))
    rows = files.select(*keys, F.substring(F.sha2("path", 256), 1, 4).alias("deal"), F.col("path").alias("place"), line.alias("line"))
    for digits in (4, 2, 0):
        lines = F.array_sort(F.collect_list(F.struct("place", "line")))
        digest = F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256)
        rows = rows.groupBy(*keys, F.substring("deal", 1, digits).alias("deal")).agg(digest.alias("digest"))
        rows = rows.select(*keys, "deal", "digest", F.col("deal").alias("place"), F.concat("deal", "digest").alias("line"))
    return rows.select(*keys, F.col("digest").alias("fingerprint"))


def statistics(files: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """(files, symbols, relations): one row."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    all_ = one(files, "files").unionByName(one(symbols, "symbols")).unionByName(one(relations, "relations"))
    return all_.agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("files", "symbols", "relations")])


def same_rows(one: DataFrame, other: DataFrame) -> DataFrame:
    """(only_in_first, only_in_second, equal): how two snapshots differ as bags of rows; one row."""
    a = one.exceptAll(other).agg(F.count("*").alias("n")).select(F.lit(1).alias("side"), "n")
    b = other.exceptAll(one).agg(F.count("*").alias("n")).select(F.lit(2).alias("side"), "n")
    n = lambda side: F.max(F.when(F.col("side") == side, F.col("n")))
    return a.unionByName(b).agg(n(1).alias("only_in_first"), n(2).alias("only_in_second")).withColumn("equal", (F.col("only_in_first") + F.col("only_in_second")) == 0)


def providers(*tables: DataFrame) -> DataFrame:
    """Distinct external providers of some tables."""
    out = tables[0].select("provider")
    for t in tables[1:]:
        out = out.union(t.select("provider"))
    return out.where(F.col("provider") != BUILTIN).distinct()


def purge_external(rows: DataFrame) -> DataFrame:
    """What stays when a source or test file changed: the built-in provider's rows."""
    return rows.where(F.col("provider") == BUILTIN)


def replace_provider(stored: DataFrame, snapshot: DataFrame, known: DataFrame, provider: str) -> DataFrame:
    """``stored`` with the provider's rows replaced by the snapshot's, those of known paths."""
    if provider == BUILTIN:
        raise ValueError("the built-in provider's rows follow the files")
    fresh = snapshot.where(F.col("provider") == provider).join(known.select("path").distinct(), "path", "left_semi").distinct()
    return stored.where(F.col("provider") != provider).unionByName(fresh.select(stored.columns))


def readiness(projects: DataFrame, status: str = "status") -> DataFrame:
    """(status, projects): every status, also those without projects."""
    spark = projects.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = projects.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("projects"))
    return every.join(counts, "status", "left").select("status", F.coalesce("projects", F.lit(0).cast("long")).alias("projects"))


def health(projects: DataFrame, status: str = "status") -> DataFrame:
    """(projects, degraded, all_ready): one row; degraded if any failed, all ready if there are some and each is."""
    is_ = lambda name: F.count_if(F.col(status) == name)
    n = F.count("*")
    return projects.agg(n.alias("projects"), (is_("FAILED") > 0).alias("degraded"), ((n > 0) & (is_("READY") == n)).alias("all_ready"))


#: Given files and symbols, all or those of the paths to do again, these paths (None: all) and the index of before: further tables to publish.
#: The number of buckets comes last.
Derive = Callable[[DataFrame, DataFrame, DataFrame | None, View | None, int], dict[str, DataFrame | Change]]
#: Windows of the postings in each bucket.
WINDOWS = 64


def terms(files: DataFrame, symbols: DataFrame, redo: DataFrame | None, view: View | None, buckets: int) -> dict[str, DataFrame | Change]:
    """The indexes of texts and of symbols: of paths to do again what was stored goes, and what there is now comes."""
    windows = WINDOWS * buckets
    fields, postings = lexical.taken_apart(lexical.named(files, symbols))
    postings = lexical.in_windows(postings, windows)
    tables = {"fields": fields, "postings": postings, "parts": symbol_index.build(symbols)}
    if redo is None:
        tables["postings"] = postings = keep(postings, "postings")
        return tables | {"blocks": lexical.blocks(postings)}
    if not all(view.has(name) for name in (*tables, "blocks")):
        raise ValueError("there is no index of texts and symbols yet: index all files first")
    tables["postings"] = postings = keep(postings, "postings")
    touched = lexical.in_windows(redo.select("path").distinct(), windows)
    beside = view.read("postings").join(touched.select("window").distinct(), "window", "left_semi").join(touched, "path", "left_anti")
    again = lexical.blocks(beside.select(postings.columns).unionByName(postings))
    return {name: Change(redo, rows) for name, rows in tables.items()} | {"blocks": Change(touched, again)}


def refresh(
    snapshots: Snapshots, scanned: DataFrame, analyse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], rescan: Callable[[], DataFrame] | None, full: bool = False, derive: Derive | None = None, part: bool = False
) -> dict:
    """Bring a project's index up to date; {changed, removed, generation}.

    ``scanned``: (path, hash, category, size, ...), ``analyse``: changed files to built-in (symbols, relations), ``rescan``: the
    files once more, to see that nothing moved meanwhile. With ``part`` only some files were scanned and no other one is gone. Without
    changes nothing is written; else the buckets of changed paths are. A change of source or test files drops external
    providers' rows. Only counts come to the driver. If another writer publishes meanwhile, all starts again.
    """
    report, held = {}, []

    def once(rows: DataFrame, label: str) -> DataFrame:
        held.append(keep(rows, label))
        return held[-1]

    def change(view: View | None) -> tuple[dict, dict] | None:
        valid = {} if rescan is None else {"still_valid": lambda written: delta(written("files"), rescan()).where("status <> 'UNCHANGED'").isEmpty()}
        if view is None or full:
            files = once(scanned, "scanned")  # a scan, read for each table that is made of it
            symbols, relations = analyse(files)
            symbols = once(symbols, "symbols")
            told = files.agg(F.count("*"), F.sum("size")).first()
            report.update(changed=told[0], removed=0)
            tables = {"files": files, "symbols": symbols, "relations": relations}
            buckets = buckets_for(told[1] or 0)
            return tables | (derive(files, symbols, None, None, buckets) if derive else {}), valid | {"buckets": buckets}
        stored = view.read("files")
        seen = stored.join(scanned.select("path"), "path", "left_semi") if part else stored
        moved = once(delta(seen, scanned).where("status <> 'UNCHANGED'"), "moved")
        counts = {r["status"]: r["n"] for r in moved.groupBy("status").agg(F.count("*").alias("n")).collect()}
        report.update(changed=counts.get("NEW", 0) + counts.get("CHANGED", 0), removed=counts.get("REMOVED", 0))
        if not counts:
            return None
        fresh = once(scanned.join(moved.where("status <> 'REMOVED'").select("path"), "path", "left_semi"), "fresh")
        gone = moved.select("path")
        code = stored.select("path", "category").unionByName(fresh.select("path", "category")).where(F.col("category").isin("SOURCE", "TEST"))
        purge = not moved.join(code, "path", "left_semi").isEmpty()
        redo, tables = gone, {"files": Change(gone, fresh)}
        for name, rows in zip(("symbols", "relations"), analyse(fresh), strict=True):
            old = view.read(name)
            paths = gone.unionByName(old.where(F.col("provider") != BUILTIN).select("path")).distinct() if purge else gone
            left = old.join(paths, "path", "left_semi").join(moved.select("path", F.lit(1).alias("moved")), "path", "left")
            left = left.where(~((F.col("provider") == BUILTIN) & F.col("moved").isNotNull())).drop("moved")
            left = purge_external(left) if purge else left
            rows = left.select(rows.columns).unionByName(rows)
            tables[name] = Change(paths, once(rows, name) if name == "symbols" else rows)
            redo = paths if name == "symbols" else redo
        if derive is not None:
            files = stored.join(redo, "path", "left_semi").join(gone, "path", "left_anti").unionByName(fresh.select(stored.columns))
            tables |= derive(files, tables["symbols"].rows, redo, view, view.buckets("files"))
        return tables, valid

    try:
        report["generation"] = snapshots.transact(change)
    finally:
        drop(*held)
    return {k: report[k] for k in ("changed", "removed", "generation")}


def published_provider(snapshots: Snapshots, new_symbols: DataFrame, new_relations: DataFrame, provider: str, derive: Derive | None = None) -> int:
    """Publish a provider's symbols and relations in place of its earlier ones, if they differ; the generation."""

    def change(view: View | None) -> tuple[dict, dict] | None:
        files, tables = view.read("files"), {}
        for name, snapshot in (("symbols", new_symbols), ("relations", new_relations)):
            stored = view.read(name)
            own = stored.where(F.col("provider") == provider)
            fresh = replace_provider(own, snapshot, files, provider)
            if same_rows(own, fresh).first()["equal"]:
                continue
            paths = own.select("path").unionByName(fresh.select("path")).distinct()
            others = stored.where(F.col("provider") != provider).join(paths, "path", "left_semi")
            tables[name] = Change(paths, others.unionByName(fresh))
        if not tables:
            return None
        if derive is not None and "symbols" in tables:
            redo = tables["symbols"].paths
            tables |= derive(files.join(redo, "path", "left_semi"), tables["symbols"].rows, redo, view, view.buckets("files"))
        return tables, {}

    return snapshots.transact(change)

"""Projects, their indexes, and the queries over them, for use from Python or the command line.

A home folder holds a registry of projects and one snapshot folder per project. Every query takes many texts at once: a
dict of query id to text runs as one job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekframe.functions import limits, text
from seekframe.kept import keep
from seekframe.operators import budget, fragments, graph, index, lexical, rank, recency, semantic, symbols, vector_index
from seekframe.operators.store import Change, Snapshots, View
from seekframe.sources import git, importers, instructions, scan, skills
from seekframe.sources.classify import candidate_type, generic
from seekframe.sources.corpus import TYPE_KINDS
from seekframe.streaming.follow import follow

REGISTRY = "project_id string, name string, root string, status string"


#: The parts of a context, in order.
PARTS = ("instructions", "skills", "history", "tasks")


class NotReady(ValueError):
    """The project has no finished index."""


class Engine:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._registry = Snapshots(spark, f"{self.home}/registry")

    # projects

    def projects(self) -> DataFrame:
        """(project_id, name, root, status)."""
        view = self._registry.view()
        return self.spark.createDataFrame([], REGISTRY) if view is None else view.read("projects")

    def _save(self, change: Callable[[list[tuple]], list[tuple]]) -> None:
        """Publish what ``change`` makes of the registry's rows; made again of newer ones if another writer was first."""

        def made(view: View | None) -> tuple[dict, dict]:
            rows = [] if view is None else [tuple(r) for r in view.read("projects").collect()]
            return {"projects": self.spark.createDataFrame(change(rows), REGISTRY).coalesce(1)}, {}

        self._registry.transact(made)

    def _rows(self) -> list[tuple]:
        return [tuple(r) for r in self.projects().orderBy("name").collect()]  # a registry, not data

    def add(self, name: str, root: str) -> str:
        """Register a folder; its id. A folder is registered once."""
        row = (str(uuid.uuid4()), name, root, "NOT_INDEXED")

        def added(rows: list[tuple]) -> list[tuple]:
            if any(r[2] == root for r in rows):
                raise ValueError("the folder is registered already")
            return [*rows, row]

        self._save(added)
        return row[0]

    def resolve(self, project: str) -> tuple:
        """The registry row of an id, or of a name whatever its case; an error unless there's exactly one."""
        try:
            wanted = str(uuid.UUID(project))
            found = [r for r in self._rows() if r[0] == wanted]
        except ValueError:
            found = [r for r in self._rows() if r[1].lower() == project.lower()]
        if len(found) != 1:
            raise ValueError(f"{len(found)} projects are called {project}")
        return found[0]

    def readiness(self) -> DataFrame:
        return index.readiness(self.projects())

    def health(self) -> DataFrame:
        return index.health(self.projects())

    def _status(self, project_id: str, status: str) -> None:
        self._save(lambda rows: [(*r[:3], status) if r[0] == project_id else r for r in rows])

    def _snapshots(self, project_id: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.home}/{project_id}")

    def index(self, project: str, rebuild: bool = False) -> dict:
        """Scan and index what changed; all of it after a failure. {changed, removed, generation}."""
        row = self.resolve(project)
        read = lambda: scan.scan(self.spark, row[2], row[1])[0]
        self._status(row[0], "INDEXING")
        try:
            report = index.refresh(self._snapshots(row[0]), read(), importers.analyse_java, read, rebuild or row[3] == "FAILED", index.terms)
        except Exception:
            self._status(row[0], "FAILED")
            raise
        self._status(row[0], "READY")
        return report

    def follow(self, project: str, versions: DataFrame, checkpoint: str, order: str = "version") -> StreamingQuery:
        """Apply a stream of file versions to a project's index; see streaming.follow."""
        return follow(versions, self._snapshots(self.resolve(project)[0]), importers.analyse_java, checkpoint, order)

    def replace_provider(self, project: str, provider: str, new_symbols: DataFrame, new_relations: DataFrame) -> int:
        """Publish an external provider's symbols and relations in place of its earlier ones; the generation."""
        return index.published_provider(self._snapshots(self.resolve(project)[0]), new_symbols, new_relations, provider, index.terms)

    def import_json(self, project: str, file: str, provider: str) -> int:
        """Take a provider's symbols and relations from a JSON snapshot of the project's folder; the generation."""
        row = self.resolve(project)
        texts = self.spark.read.text(scan.plain_file(self.spark, file, importers.SNAPSHOT_MOST), wholetext=True)
        return self.replace_provider(row[0], provider, *importers.json_snapshot(texts, self.table(row[0], "files"), row[2], provider))

    def import_index(self, project: str, file: str, provider: str) -> int:
        """Take a provider's symbols and relations from a protobuf index; the generation."""
        row = self.resolve(project)
        blobs = self.spark.read.format("binaryFile").load(scan.plain_file(self.spark, file, importers.INDEX_MOST))
        return self.replace_provider(row[0], provider, *importers.protobuf_index(blobs.select("content"), provider))

    def index_vectors(self, project: str, vectors: DataFrame, provenance: dict, rebuild: bool = False) -> int:
        """Store vectors (path, v) of files; the generation.

        Of the same provenance, paths that are given replace their own; otherwise, or with ``rebuild``, all are replaced.
        """
        told = semantic.provenance(provenance)

        def change(view: View) -> tuple[dict, dict]:
            files = view.read("files").select("path")
            fresh = vectors.where(semantic.valid(F.col("v")) & (F.size("v") == int(told["dimensions"]))).select("path", F.col("v").cast("array<double>").alias("v"))
            fresh = fresh.dropDuplicates(["path"]).join(files, "path", "left_semi")
            if not rebuild and self._provenance(view) == told:
                return {"vectors": Change(vectors.select("path"), vector_index.assigned(fresh, view.read("centroids"), "path"))}, {}
            rows = self.spark.createDataFrame(sorted(told.items()), "field string, value string").coalesce(1)
            middles = vector_index.centroids(fresh)
            return {"vectors": vector_index.assigned(fresh, middles, "path"), "centroids": middles, "provenance": rows}, {"buckets": view.buckets("files")}

        return self._snapshots(self.resolve(project)[0]).transact(change)

    @staticmethod
    def _provenance(view: View | None) -> dict[str, str] | None:
        if view is None or not view.has("provenance"):
            return None
        return {r["field"]: r["value"] for r in view.read("provenance").collect()}  # six rows

    def _ready(self, project: str) -> View:
        """The newest generation of a project that has a finished index."""
        row = self.resolve(project)
        if row[3] != "READY":
            raise NotReady(f"{row[1]} is {row[3]}")
        return self._snapshots(row[0]).view()

    def table(self, project: str, name: str) -> DataFrame:
        return self._ready(project).read(name)

    def files(self, project: str) -> DataFrame:
        """The project's files in order of path."""
        return self.table(project, "files").orderBy("path")

    def git(self, project: str) -> tuple[DataFrame, DataFrame]:
        """(changes, diffs) of the project's folder, if it's a git repository."""
        root = self.resolve(project)[2]
        return git.changes(self.spark, root), git.diffs(self.spark, root)

    def inspect(self, project: str) -> DataFrame:
        return index.statistics(*[self.table(project, t) for t in ("files", "symbols", "relations")])

    # search

    def find_symbols(self, project: str, query: str, limit: int | None = None) -> DataFrame:
        return symbols.find(self.table(project, "symbols"), [query.strip()], limits.results(limit), self.table(project, "parts"))

    def find_usages(self, project: str, query: str, limit: int | None = None) -> DataFrame:
        return symbols.usages(self.table(project, "relations"), query.strip(), limits.results(limit))

    def edges(self, project: str) -> DataFrame:
        """(src, dst) files connected by imports that a file's types resolve."""
        return self._edges(self._ready(project))

    @staticmethod
    def _edges(view: View) -> DataFrame:
        owners = symbols.owners(view.read("symbols"), TYPE_KINDS)
        refs = view.read("relations").where("kind = 'IMPORTS'").select("source", "target").distinct()
        return graph.longest_owner(refs, owners, ["source", "target"]).select(F.col("source").alias("src"), F.col("owner").alias("dst"))

    def _near(self, view: View, vectors: dict[int, list[float]], provenance: dict, limit: int) -> DataFrame | None:
        """(query_id, path, semantic) of the stored vectors next to the queries'; None where none are stored or provenance differs."""
        if self._provenance(view) != semantic.provenance(provenance):
            return None
        asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "query_id int, q array<double>")
        rows = view.read("vectors").join(view.read("files").select("path"), "path", "left_semi").withColumnRenamed("path", "id")
        found = vector_index.nearest(rows, view.read("centroids"), asked, limit)
        return found.select("query_id", F.col("id").alias("path"), F.col("score").alias("semantic"))

    def search(
        self, project: str, queries: dict[int, str], limit: int | None = None, changes: DataFrame | None = None, vectors: dict[int, list[float]] | None = None, provenance: dict | None = None, fuse: float | None = None
    ) -> DataFrame:
        """(query_id, rank, id, type, path, symbol, score, explanation) of each text.

        ``changes``: (commit, at, path, root), if recent changes are to count. ``vectors``: the queries' vectors, of the given
        provenance; they count only if the stored ones have the same. ``fuse``: a weight, to rank by reciprocal ranks.
        """
        limit = limits.results(limit)
        pool = limits.search_pool(limit)
        asked = self.spark.createDataFrame([(i, q.strip()) for i, q in queries.items()], "query_id int, query string")
        view = self._ready(project)  # one generation for all that a search reads
        files = view.read("files").where(generic(F.col("category")))
        known = view.read("symbols")
        kinds = files.select("path", candidate_type(F.col("category")).alias("type"))
        hits = lexical.search_best(view.read("fields"), view.read("postings"), view.read("blocks"), asked, 2 * pool)
        hits = lexical.candidates(hits, asked, pool, kinds).join(kinds, "path")
        none = F.lit(None).cast("string")
        rows = hits.select("query_id", F.concat(F.lit("file:"), "path").alias("id"), "type", "path", none.alias("symbol"), F.lit(0).alias("arrival"), "lexical", "path_signal")
        said = symbols.scored(known, [q.strip() for q in queries.values()], limits.symbol_pool(limit), pool, view.read("parts"))
        said = said.join(F.broadcast(asked.select("query_id", F.lower("query").alias("query"))), "query")
        rows = rows.unionByName(said.select("query_id", "id", F.lit("SYMBOL").alias("type"), "path", F.col("qualified").alias("symbol"), F.lit(1).alias("arrival"), "exact", "fuzzy", "path_signal"), allowMissingColumns=True)
        near = self._near(view, vectors, provenance or {}, pool) if vectors else None
        if near is not None:
            rows = rows.unionByName(near.join(kinds, "path").select("query_id", F.concat(F.lit("file:"), "path").alias("id"), "type", "path", none.alias("symbol"), F.lit(2).alias("arrival"), "semantic"), allowMissingColumns=True)
        direct = keep(rank.merge(rows), "direct")
        seeds = direct.select("query_id", "path", F.greatest("lexical", "exact", "fuzzy", "path_signal").alias("score"))
        near = graph.spread(seeds, self._edges(view), files, ("query_id",)).join(kinds, "path")
        # what only the graph brings is a file or a test
        kind = F.when(F.col("type") == "TEST", "TEST").otherwise("FILE")
        near = near.select("query_id", F.concat(F.lit("file:"), "path").alias("id"), kind.alias("type"), "path", none.alias("symbol"), F.lit(3).alias("arrival"), "graph")
        merged = rank.merge(direct.withColumn("arrival", F.lit(0)).unionByName(near, allowMissingColumns=True))
        if changes is not None:
            log = changes.select("commit", "at").distinct()
            roots = changes.where("root").select("commit").distinct()
            scored = recency.scores(log, changes.where("path is not null").join(roots, "commit", "left_anti").select("commit", "path"), F.lit(False))
            merged = merged.drop("recency").join(scored, "path", "left").withColumn("recency", F.coalesce("recency", F.lit(0.0)))
        if fuse is None:
            return rank.ranked(merged, limit).select("query_id", "rank", "id", "type", "path", "symbol", "score", "explanation")
        fused = rank.fused(merged, limit, fuse)
        told = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))  # noqa: E731  null where there is no such rank
        fused = fused.withColumn("explanation", F.concat_ws(" ", told("baseline_rank"), told("semantic_rank")))
        return fused.join(merged.select("query_id", "id", "type", "symbol"), ["query_id", "id"]).select("query_id", "rank", "id", "type", "path", "symbol", "score", "explanation")

    def _scope(self, projects: list[str]) -> list[tuple]:
        """The registry rows of several projects, each once."""
        rows = list({r[0]: r for r in (self.resolve(p) for p in projects)}.values())
        if not 1 <= len(rows) <= limits.PROJECTS_MOST:
            raise ValueError(f"1 to {limits.PROJECTS_MOST} projects")
        return rows

    def search_federated(self, projects: list[str], queries: dict[int, str], limit: int | None = None) -> DataFrame:
        """(query_id, place, project, path, score, ...): the best files of several projects, each path once."""
        limit = limits.results(limit)
        each = [
            self.search(row[0], queries, limits.local_pool(limit)).withColumn("project", F.lit(row[1])).withColumn("project_place", F.lit(place))
            for place, row in enumerate(self._scope(projects), 1)
        ]
        return rank.federated(reduce(DataFrame.unionByName, each), limit)

    # context

    def context(
        self, project: str, query: str, tokens: int | None = None, sources: tuple[str, ...] = (), changes: DataFrame | None = None, diffs: DataFrame | None = None, registry: DataFrame | None = None
    ) -> DataFrame:
        """(part, place, path, start_line, end_line, tokens, cut, content): instructions, skills, history and task fragments within a budget.

        ``sources``: candidate types to take fragments from; all if empty. ``changes``: (commit, at, path, message), for a
        history part, and ``diffs``: (zone, content). ``registry``: (name, description, path, content), skills known elsewhere.
        """
        tokens = limits.budget(tokens)
        found = keep(self.search(project, {1: query}, limits.context_pool(tokens)), "ranked")
        files = self.table(project, "files")
        split = limits.budget_split(tokens, history=changes is not None)
        lined = lambda df: df.withColumn("start_line", F.lit(1)).withColumn("end_line", F.size(fragments.lines(F.col("content"))))

        told = files.where("category = 'INSTRUCTION'").select("path", "content", F.col("project").alias("provider"), instructions.priority(F.col("path")).alias("priority"))
        paths = [r["path"] for r in found.select("path").distinct().collect()]  # a result list
        told = instructions.by_path(instructions.applicable(told, found.select("path").distinct()), paths)
        told = instructions.first_of_content(instructions.with_references(told, files))
        told = lined(told).select(F.lit("instructions").alias("part"), "path", "start_line", "end_line", (F.col("priority") / 100).alias("score"), "content")

        native = told.select("path").distinct()
        ranked = found.join(native, "path", "left_anti")
        ranked = ranked.where(F.col("type").isin(*sources)) if sources else ranked
        tasks = self._fragments(project, query, ranked, files, tokens).select(F.lit("tasks").alias("part"), "path", "start_line", "end_line", "score", "content")

        given = [("instructions", told), ("skills", self._skills(query, files, registry)), ("tasks", tasks)]
        if changes is not None:
            targets = [r["path"] for r in found.groupBy("path").agg(F.min("rank").alias("n")).orderBy("n", "path").collect()]
            past = recency.fragments(changes.where("path is not null"), targets, diffs).select(F.lit("history").alias("part"), F.col("kind").alias("path"), "score", "content")
            given.insert(2, ("history", lined(past).select("part", "path", "start_line", "end_line", "score", "content")))
        parts = None
        for name, rows in given:
            if split[name] > 0:
                own = budget.greedy_truncating(rows, split[name], "part", texts=True)
                own = own.where("not cut") if name == "skills" else own  # a skill is whole or left out
                parts = own if parts is None else parts.unionByName(own)
        return parts.select("part", "place", "path", "start_line", "end_line", "tokens", "cut", "content")

    def context_federated(self, projects: list[str], query: str, tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(items, shares): one budget for several projects, and what each got of it.

        items: (place, project, part, path, start_line, end_line, tokens, refill, content), shares: (project, tokens, items, starved).
        Every project offers its own context, up to three times its fair part, in the order of its parts.
        """
        tokens = limits.budget(tokens)
        scope = self._scope(projects)
        parts = F.array(*[F.lit(p) for p in PARTS])
        each = []
        for place, row in enumerate(scope):
            fair, most = limits.fair_share(tokens, len(scope), place)
            own = self.context(row[0], query, most).withColumn("part_place", F.array_position(parts, F.col("part")))
            each.append(own.select("*", F.lit(row[1]).alias("project"), F.lit(place).alias("project_place"), F.lit(fair).alias("fair")))
        rows = keep(reduce(DataFrame.unionByName, each), "offered")
        order = W.partitionBy("project").orderBy("part_place", "place", "path", "start_line")
        rows = rows.withColumn("item_place", F.row_number().over(order)).withColumn("key", F.concat_ws("\0", "part", "path", F.col("start_line").cast("string")))
        offered = rows.select(F.lit(1).alias("query_id"), "project", "project_place", "item_place", F.col("key").alias("path"), "tokens", "fair", F.col("part").alias("type"), "content")
        took = budget.federated(offered, tokens).withColumnRenamed("path", "key").select("place", "project", "key", "refill")
        items = took.join(rows.drop("place"), ["project", "key"]).select("place", "project", "part", "path", "start_line", "end_line", "tokens", "refill", "content")
        names = self.spark.createDataFrame([(r[1],) for r in scope], "project string")
        return items, budget.shares(items, names)

    def _skills(self, query: str, files: DataFrame, registry: DataFrame | None) -> DataFrame:
        """The skills that a query asks for, as fragments: those of the project's folders, and after them the registry's."""
        told = files.where("category = 'SKILL' and path like '%/SKILL.md'").select("path", "content")
        read = skills.defined(told).select("name", "description", "path", F.lit(skills.LOCAL).alias("priority"), "content")
        if registry is not None:
            read = read.unionByName(registry.select("name", "description", "path", F.lit(skills.REGISTERED).alias("priority"), "content"))
        chosen = skills.select(skills.first_of_name(read.drop("content")), self.spark.createDataFrame([(1, query)], "query_id int, query string"))
        both = chosen.join(read.select("path", "content"), "path")
        return both.select(F.lit("skills").alias("part"), "path", F.lit(1).alias("start_line"), F.size(fragments.lines(F.col("content"))).alias("end_line"), "score", "content")

    def _fragments(self, project: str, query: str, ranked: DataFrame, files: DataFrame, tokens: int) -> DataFrame:
        """(path, start_line, end_line, score, content): symbols' lines where a file has symbol candidates, else what the query hits."""
        texts = files.select("path", "content").join(ranked.select("path").distinct(), "path", "left_semi")
        by_symbol = ranked.where("type = 'SYMBOL'").select("path", F.col("symbol").alias("qualified"), "type", "score")
        known = self.table(project, "symbols").select("path", "qualified", "start_line", "end_line").distinct()
        windows = fragments.symbol_windows(known.join(by_symbol, ["path", "qualified"], "left_semi"), texts)
        one = windows.join(by_symbol.withColumnRenamed("qualified", "symbol"), ["path", "symbol"]).select("path", "start_line", "end_line", "type", "symbol", "score")
        plain = ranked.join(by_symbol.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.max_by("type", "score").alias("type"), F.max("score").alias("score"))
        bodies = texts.join(plain, "path")
        small = text.token_estimate(F.col("content")) <= limits.full_file_threshold(tokens)
        whole = bodies.where(small).select("path", F.lit(1).alias("start_line"), F.size(fragments.lines(F.col("content"))).alias("end_line"))
        terms = [r["t"] for r in self.spark.range(1).select(F.explode(text.terms(F.lit(query), 2)).alias("t")).collect()]
        some = fragments.query_windows(bodies.where(~small), terms)
        rest = whole.unionByName(some).join(plain, "path").select("path", "start_line", "end_line", "type", F.lit(None).cast("string").alias("symbol"), "score")
        merged = fragments.merged(one.unionByName(rest).withColumn("reasons", F.array(F.lit("search"))))
        return merged.join(texts, "path").withColumn("content", fragments.text_of(F.col("content"), F.col("start_line"), F.col("end_line")))

"""Instruction files: where they apply and how much they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.functions.text import fingerprint
from seekframe.kept import keep
from seekframe.sources.classify import name_of

# First priority, step per folder, most.
BY_DEPTH = {"agents.md": (74, 4, 94), "agent.md": (64, 4, 94), "claude.md": (80, 3, 94), "gemini.md": (70, 3, 90)}
REPOSITORY, BY_PATH, REFERENCE = 78, 96, 5


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def depth_of(path: Column) -> Column:
    """Folders above a file."""
    return F.size(F.split(path, "/")) - 1


def priority(path: Column) -> Column:
    """0 to 100 by the file's name and depth; null for other files."""
    low, depth = F.lower(path), depth_of(path)
    out = F.when(low == ".github/copilot-instructions.md", REPOSITORY).when(low.startswith(".github/instructions/") & low.endswith(".instructions.md"), BY_PATH)
    for name, (first, step, most) in BY_DEPTH.items():
        out = out.when(name_of(low) == name, F.least(F.lit(most), first + step * depth))
    return out.cast("int")


def reference_priority(parent: Column, depth: Column) -> Column:
    return F.greatest(F.lit(0), parent - REFERENCE - depth).cast("int")


def applicable(instructions: DataFrame, targets: DataFrame) -> DataFrame:
    """Instructions whose folder holds a target path; the root's and those in ``.github`` apply to all, targets or not.

    ``instructions``: (path, ...), ``targets``: (path). Folders of targets are exploded, so this is an equi-join.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = targets.select(F.explode(above).alias("folder")).distinct()
    own = instructions.withColumn("folder", F.when(F.lower("path").startswith(".github/"), "").otherwise(folder_of(F.col("path"))))
    root = own.where("folder = ''")
    return root.unionByName(own.where("folder <> ''").join(folders, "folder", "left_semi").select(root.columns)).drop("folder")


def first_of_content(sources: DataFrame, content: str = "content", order: tuple[Column | str, ...] | None = None) -> DataFrame:
    """One row per content, line ends and outer white space aside: highest priority, then path, then provider."""
    by = order or (F.desc("priority"), "path", "provider")
    place = F.row_number().over(W.partitionBy("print").orderBy(*by))
    return sources.withColumn("print", fingerprint(F.col(content))).withColumn("n", place).where("n = 1").drop("n")


def apply_to(text: Column) -> Column:
    """The patterns of the ``applyTo`` key between a text's first two ``---`` lines, without quotes and brackets; none if blank.

    Only white space may stand before the opening line's end; the first such key counts.
    """
    head = F.regexp_extract(text, r"(?s)\A[ \t]*---[ \t]*\r?\n(.*?)(\r?\n[ \t]*---[ \t]*(\r?\n|\z)|\z)", 1)
    raw = F.trim(F.regexp_extract(head, r"(?m)^[ \t]*applyTo:(.*)$", 1))
    bare = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), r"^\[(.*)\]$", "$1")), r"""^(?:"(.*)"|'(.*)')$""", "$1$2"))
    parts = F.transform(F.split(bare(raw), ","), bare)
    return F.filter(parts, lambda p: p != "")


def glob_pattern(glob: Column) -> Column:
    """A repository glob as an anchored regular expression, as glob_regex() makes it."""
    out = F.regexp_replace(glob, r"([\\.+^$(){}|\[\]])", r"\\$1")
    for token, pattern in (("**/", "\u0001"), ("**", "\u0002"), ("*", "[^/]*"), ("?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".*")):
        out = F.replace(out, F.lit(token), F.lit(pattern))
    return F.concat(F.lit("^"), out, F.lit("$"))


def by_path(instructions: DataFrame, targets: list[str]) -> DataFrame:
    """Instructions for paths, ``.github/instructions``: those one of whose patterns fits a target. Others aren't touched.

    ``instructions``: (path, content, ...), ``targets``: the paths of a result list, a literal.
    """
    low = F.lower("path")
    special = low.startswith(".github/instructions/") & low.endswith(".instructions.md")
    wanted = F.array(*[F.lit(t) for t in targets]).cast("array<string>")
    fits = F.exists(apply_to(F.col("content")), lambda p: F.exists(wanted, lambda t: F.regexp(t, glob_pattern(p))))
    return instructions.where(~special | fits)


def references(text: Column) -> Column:
    """What ``@`` names in a text, outside fenced blocks, in order: at a line's start or after white space."""
    opens = lambda line: F.ltrim(line).startswith("```") | F.ltrim(line).startswith("~~~")
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\x0B\f\r\x85\u2028\u2029]", -1)
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("kept"))
    # a file of rules is short; lines outside fences are few enough to be collected one by one
    step = lambda a, line: F.struct((a["fenced"] != opens(line)).alias("fenced"), F.when(a["fenced"] | opens(line), a["kept"]).otherwise(F.concat(a["kept"], F.array(line))).alias("kept"))
    plain = F.when(F.coalesce(text, F.lit("")).contains("@"), F.aggregate(lines, start, step, lambda a: a["kept"])).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(plain, lambda line: F.regexp_extract_all(line, F.lit(r"(?:^|\s)@([A-Za-z0-9._/\\-]+)"), F.lit(1))))


def resolved(folder: Column, name: Column) -> Column:
    """A relative name seen from a folder as a path from the root; null where it leaves the root or isn't relative."""
    parts = F.split(F.concat_ws("/", folder, F.replace(name, F.lit("\\"), F.lit("/"))), "/")
    start = F.array().cast("array<string>")

    def step(a: Column, part: Column) -> Column:
        up = F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1))
        return F.when(a.isNull() | part.isin("", "."), a).when(part == "..", up).otherwise(F.concat(a, F.array(part)))

    path = F.array_join(F.aggregate(parts, start, step), "/")
    return F.when(~F.startswith(name, F.lit("/")) & ~F.startswith(name, F.lit("~")) & (path != ""), path)


def with_references(instructions: DataFrame, files: DataFrame, depth: int = 5) -> DataFrame:
    """``instructions`` (path, content, provider, priority) and the files that they name, and those that these name.

    A name is looked up from the naming file's folder, then from the root, among ``files`` (path, content). Level by level up
    to ``depth``; a file counts once for each instruction, at its least depth, with a priority that falls with it.
    """
    columns = ["path", "content", "provider", "priority"]
    frontier = keep(instructions.select(F.col("path").alias("root"), F.col("priority").alias("first"), *columns), "references")
    out = seen = frontier
    for level in range(1, depth + 1):
        named = frontier.select("root", "first", "provider", F.posexplode(references(F.col("content"))).alias("n", "name"), folder_of(F.col("path")).alias("folder"), F.col("path").alias("by"))
        tries = F.array(resolved(F.col("folder"), F.col("name")), resolved(F.lit(""), F.col("name")))
        tried = named.select("*", F.posexplode(tries).alias("try", "path")).where("path is not null")
        met = tried.join(files.select("path", "content"), "path")
        best = met.groupBy("root", "by", "n").agg(F.min_by(F.struct("first", "provider", "path", "content"), "try").alias("x")).select("root", "x.*")
        best = best.groupBy("root", "path").agg(F.first("first").alias("first"), F.min("provider").alias("provider"), F.first("content").alias("content"))
        fresh = best.join(seen.select("root", "path"), ["root", "path"], "left_anti")
        frontier = keep(fresh.withColumn("priority", reference_priority(F.col("first"), F.lit(level))).select(frontier.columns), "references")
        if frontier.isEmpty():
            break
        out = seen = out.unionByName(frontier)
    return out.select(columns)

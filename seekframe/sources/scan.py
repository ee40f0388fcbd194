"""Repository scan: files under a folder, as a table."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.functions.text import scan_estimate
from seekframe.kept import keep
from seekframe.sources.classify import OWN_FOLDER, SKIPPED_FOLDERS, category, ignore_rules, ignored, language, skipped

MOST_BYTES = 8 << 20
#: Families of ignore files; a path goes if any family says so.
IGNORE_FILES = (".gitignore", ".ignore")
#: Ignore files of a project, which come to the driver.
RULES_MOST = 100_000
#: Entries that a task lists before it leaves the folders that are still to do to others.
ENTRIES = 2_000
#: Bytes and files that a task reads.
READ_BYTES, READ_FILES = 64 << 20, 1_000
_LISTED = "path string, address string, kind string, length long"
_KINDS = {"link": "a link", "odd": "not a regular file"}


def listing(spark: SparkSession, root: str, never: set[str], entries: int = ENTRIES) -> DataFrame:
    """(path, address, kind, length) of what lies under a folder: kind file, link or odd. Folders named in ``never`` are left.

    Tasks list: each goes down from its folder until it has seen enough, and gives the folders it hasn't opened to the next round.
    """

    def inner(address: str) -> list[tuple[str, str, int]]:
        """(name, kind, length) of what a folder holds; links aren't followed."""
        local = address.removeprefix("file:")
        if local == address:
            system, name = fs.FileSystem.from_uri(address)
            kinds = {fs.FileType.File: "file", fs.FileType.Directory: "folder"}
            return [(i.base_name, kinds.get(i.type, "odd"), i.size or 0) for i in system.get_file_info(fs.FileSelector(name))]
        out = []
        with os.scandir(local) as found:
            for entry in found:
                told = entry.stat(follow_symlinks=False)
                kind = next((k for k, test in (("link", stat.S_ISLNK), ("file", stat.S_ISREG), ("folder", stat.S_ISDIR)) if test(told.st_mode)), "odd")
                out.append((entry.name, kind, told.st_size))
        return out

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = {"path": pa.string(), "address": pa.string(), "kind": pa.string(), "length": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in zip(batch.column("path").to_pylist(), batch.column("address").to_pylist(), strict=True):
                waiting, seen = [top], 0
                while waiting and seen < entries:
                    path, address = waiting.pop()
                    rows = [(f"{path}/{n}" if path else n, f"{address}/{n}", kind, size) for n, kind, size in inner(address) if n.lower() not in never]
                    seen += 1 + len(rows)
                    waiting += [r[:2] for r in rows if r[2] == "folder"]
                    yield packed([r for r in rows if r[2] != "folder"])
                yield packed([(*w, "folder", 0) for w in waiting])

    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    at = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    level = spark.createDataFrame([("", at)], "path string, address string")
    rounds, tasks = [], 1
    while tasks:
        found = keep(level.repartition(min(tasks, 10_000)).mapInArrow(walk, _LISTED), "listing")
        rounds.append(found.where("kind <> 'folder'"))
        level = found.where("kind = 'folder'").select("path", "address")
        tasks = level.count()
    return reduce(DataFrame.unionByName, rounds)


def _contents(files: DataFrame) -> DataFrame:
    """(path, length, content) of listed files, read by tasks. A file that became a link meanwhile is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for path, address in zip(*[batch.column(c).to_pylist() for c in ("path", "address")], strict=True):
                local = address.removeprefix("file:")
                if local == address:
                    system, name = fs.FileSystem.from_uri(address)
                    with system.open_input_stream(name) as stream:
                        body = stream.read()
                else:
                    with os.fdopen(os.open(local, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb") as stream:
                        body = stream.read()
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [len(body)], "content": [body]}, schema)

    told = files.agg(F.sum("length").alias("bytes"), F.count("*").alias("files")).first()
    tasks = 1 + (told["bytes"] or 0) // READ_BYTES + told["files"] // READ_FILES
    return files.select("path", "address").repartition(min(tasks, 100_000)).mapInArrow(read, "path string, length long, content binary")


def scan(spark: SparkSession, root: str, project: str, ignore_files: tuple[str, ...] = IGNORE_FILES, own_folder: str = OWN_FOLDER) -> tuple[DataFrame, DataFrame]:
    """(files, diagnostics) of a project folder.

    files: (project, path, language, category, size, hash, tokens, content), known languages only. Diagnostics (path, reason)
    are files over the size limit, links, which are not followed, and what is neither file nor folder. Tasks list the folders and
    read the files that are wanted; only ignore files, which are rules, come to the driver.
    """
    found = listing(spark, root, {*SKIPPED_FOLDERS, own_folder.lower()})
    listed = found.where("kind = 'file'")
    known = listed.where(~skipped(F.col("path"), own_folder) & language(F.col("path")).isNotNull())
    ruling = listed.where(F.substring_index("path", "/", -1).isin(*ignore_files) & (F.col("length") <= MOST_BYTES)) if ignore_files else listed.limit(0)
    told = _contents(ruling).limit(RULES_MOST + 1).collect()
    if len(told) > RULES_MOST:
        raise ValueError("too many ignore files")
    rules = sorted(((r["path"], r["content"].decode("utf-8", "replace")) for r in told), key=lambda r: (r[0].count("/"), r[0]))
    families = [[(p.rpartition("/")[0], ignore_rules(text)) for p, text in rules if p.rpartition("/")[2] == name] for name in ignore_files]
    if any(families):
        known = known.where(~ignored(F.col("path"), families))
    files = _contents(known.where(F.col("length") <= MOST_BYTES)).select(
        F.lit(project).alias("project"),
        "path",
        language(F.col("path")).alias("language"),
        category(F.col("path")).alias("category"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("hash"),
        scan_estimate(F.col("length")).alias("tokens"),
        F.decode("content", "UTF-8").alias("content"),
    )
    large = known.where(F.col("length") > MOST_BYTES).select("path", F.lit("larger than the limit").alias("reason"))
    reason = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("kind")]
    return files, large.unionByName(found.where(F.col("kind").isin(*_KINDS)).select("path", reason.alias("reason")))


def plain_file(spark: SparkSession, path: str, most: int) -> str:
    """The address of one regular file of at most so many bytes that isn't a link; ValueError otherwise.

    Wildcards aren't expanded: a file is read by the name that it has.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    at = system.makeQualified(at)
    if not system.exists(at):
        raise ValueError("there is no such file")
    local = at.toUri().getScheme() == "file"
    status = system.getFileLinkStatus(at) if system.supportsSymlinks() else system.getFileStatus(at)
    regular = stat.S_ISREG(os.lstat(at.toUri().getPath()).st_mode) if local else status.isFile()
    if status.isSymlink() or not regular:
        raise ValueError("the file is a link or no regular file")
    if status.getLen() > most:
        raise ValueError("the file is too large")
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", at.toString())


def inside(root: str, path: str) -> str:
    """The real place of a local path that must lie in a local root, no part of it a link; ValueError otherwise."""
    top = os.path.realpath(root)
    full = os.path.normpath(os.path.join(top, path))
    if full != top and not full.startswith(top + os.sep):
        raise ValueError("the path leaves the root")
    if os.path.realpath(full) != full:
        raise ValueError("the path goes through a link")
    return full

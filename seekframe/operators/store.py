"""Tables of an index in generations: published whole or not at all, and changed bucket by bucket.

A generation is one small file in ``log/``, named by its number, that says which folders hold which part of each table. It is written
aside and then given its name in one step that fails if the name is taken: of two writers that build on the same generation one
is first, and the other starts again from what the first published. Nothing that a generation names is ever changed,
so a writer that stops between any two steps leaves the generation before, and folders that no generation names.

Tables with paths are dealt into buckets by a hash of the path. A change of some paths writes their buckets only; the others'
folders are carried over. Tables that a publication doesn't mention stay as they are.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table, and the bytes of text that one is meant for.
BUCKETS_LEAST, BUCKETS_MOST, BUCKET_BYTES = 4, 1 << 16, 8 << 20
#: Generations that readers may still hold.
KEPT = 3
TRIES = 20
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass
class Change:
    """Instead of a whole table: its rows of ``paths`` (path) are replaced by ``rows``.

    A table without paths may have windows, numbers that a power of two deals paths into; ``paths`` then names windows.
    """

    paths: DataFrame
    rows: DataFrame


def buckets_for(size: int) -> int:
    """A power of two: the buckets for so many bytes of text."""
    return min(BUCKETS_MOST, max(BUCKETS_LEAST, 1 << max(0, (size // BUCKET_BYTES).bit_length())))


def _key(columns: list[str]) -> str | None:
    return next((c for c in ("path", "window") if c in columns), None)


def _bucket(columns: list[str], buckets: int) -> Column:
    """A path's bucket; that of a window, if there are at least as many windows as buckets, is its paths'."""
    number = F.xxhash64("path") if _key(columns) == "path" else F.col("window")
    return F.pmod(number, F.lit(buckets)).cast("int")


class View:
    """The tables of one generation; they stay what they are whatever is published later."""

    def __init__(self, spark: SparkSession, root: str, pointer: dict):
        self.spark, self.root, self.pointer = spark, root, pointer

    @property
    def generation(self) -> int:
        return self.pointer["generation"]

    def has(self, name: str) -> bool:
        return name in self.pointer["tables"]

    def buckets(self, name: str) -> int:
        return self.pointer["tables"][name]["buckets"]

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or those of its buckets that are asked for."""
        if not self.has(name):
            raise ValueError(f"there is no published table {name}")
        told = self.pointer["tables"][name]
        schema = StructType.fromJson(told["schema"])
        parts = [f"{self.root}/{where}" for n, where in told["parts"].items() if buckets is None or int(n) in buckets]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)


class Snapshots:
    """The generations of an index under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files, by Spark's file systems

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _create(self, name: str, body: str) -> None:
        """Give ``body`` a name in one step; a Conflict if it's taken."""
        fs, aside, goal = self._fs(), self._path(f"log/.{uuid.uuid4().hex}"), self._path(name)
        out = fs.create(aside, False)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            local = urlparse(fs.makeQualified(goal).toString())
            if local.scheme == "file":  # its rename would replace a file; a link doesn't
                os.link(urlparse(fs.makeQualified(aside).toString()).path, local.path)
            else:
                options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
                none = self.spark.sparkContext._gateway.new_array(options, 0)
                self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, goal, none)
        except Exception as e:
            if fs.exists(goal):
                raise Conflict(f"{name} is taken") from e
            raise
        finally:
            fs.delete(aside, False)

    # reading

    def view(self, generation: int | None = None) -> View | None:
        """The newest generation, or a given one; None before the first."""
        numbers = [int(n) for n in self._names("log") if n.isdigit()]
        if not numbers:
            return None
        number = max(numbers) if generation is None else generation
        stream = self._fs().open(self._path(f"log/{number:08d}"))
        try:
            body = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return View(self.spark, self.root, json.loads(body))

    def current(self) -> dict | None:
        """The newest generation's number and tables; None before the first."""
        view = self.view()
        return None if view is None else view.pointer

    def read(self, name: str) -> DataFrame:
        view = self.view()
        if view is None:
            raise ValueError(f"there is no published table {name}")
        return view.read(name)

    # writing

    def publish(
        self, tables: dict[str, DataFrame | Change], still_valid: Callable[[Callable[[str], DataFrame]], bool] = lambda written: True, base: View | None = None, buckets: int = BUCKETS_LEAST, drop: tuple[str, ...] = ()
    ) -> int:
        """Write a generation after ``base`` and publish it; its number.

        A Conflict if another was published after ``base`` meanwhile. ``still_valid`` gets a reader of the tables as they will be.
        ``drop``: tables that are no longer published.
        """
        number = (base.generation if base else 0) + 1
        folder = f"data/{number:08d}-{uuid.uuid4().hex[:8]}"
        known = {name: told for name, told in (base.pointer["tables"] if base else {}).items() if name not in drop}
        try:
            for name, rows in tables.items():
                known[name] = self._changed(folder, name, rows, base) if isinstance(rows, Change) else self._whole(folder, name, rows, buckets)
            pointer = {"generation": number, "tables": known}
            if not still_valid(View(self.spark, self.root, pointer).read):
                raise RuntimeError("the source changed while it was indexed")
            self._create(f"log/{number:08d}", json.dumps(pointer))
        except Exception:
            self._fs().delete(self._path(folder), True)
            raise
        return number

    def transact(self, change: Callable[[View | None], tuple[dict, dict] | None], tries: int = TRIES) -> int | None:
        """Publish what ``change`` makes of the newest generation, once more if another writer was first; the generation.

        ``change`` gives (tables, further arguments of publish()), or None if there's nothing to publish.
        """
        for left in range(tries - 1, -1, -1):
            base = self.view()
            made = change(base)
            if made is None:
                return None if base is None else base.generation
            try:
                number = self.publish(made[0], base=base, **made[1])
            except Exception:  # a Conflict, or files that went with a generation that is no longer kept
                newest = self.view()
                if not left or newest is None or newest.generation == (base.generation if base else 0):
                    raise
                continue
            self.vacuum()
            return number

    def _whole(self, folder: str, name: str, rows: DataFrame, buckets: int) -> dict:
        told = {"schema": json.loads(rows.schema.json()), "buckets": buckets if _key(rows.columns) else 0}
        return told | {"parts": self._written(folder, name, rows, told["buckets"])}

    def _changed(self, folder: str, name: str, change: Change, base: View) -> dict:
        told = base.pointer["tables"][name]
        buckets = told["buckets"]
        key = _key([f["name"] for f in told["schema"]["fields"]])
        paths = change.paths.select(key).unionByName(change.rows.select(key)).distinct()
        touched = {r[0] for r in paths.select(_bucket([key], buckets)).distinct().collect()}  # at most BUCKETS_MOST numbers
        stay = base.read(name, touched)
        rows = stay.join(change.paths.select(key).distinct(), key, "left_anti").select(stay.columns).unionByName(change.rows.select(stay.columns))
        parts = {n: where for n, where in told["parts"].items() if int(n) not in touched}
        return told | {"parts": parts | self._written(folder, name, rows, buckets)}

    def _written(self, folder: str, name: str, rows: DataFrame, buckets: int) -> dict[str, str]:
        where = f"{folder}/{name}"
        if not buckets:
            rows.write.parquet(f"{self.root}/{where}")
            return {"0": where}
        # a query's terms or lists prune to few row groups of a file
        order = [_BUCKET, *[c for c in ("term", "window", "list") if c in rows.columns]]
        dealt = rows.withColumn(_BUCKET, _bucket(rows.columns, buckets)).repartition(_BUCKET).sortWithinPartitions(*order)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.root}/{where}")
        return {n.split("=")[1]: f"{where}/{n}" for n in self._names(where) if n.startswith(_BUCKET)}

    def vacuum(self, keep: int = KEPT) -> None:
        """Delete what only generations before the last ``keep`` name.

        A folder's number is the generation that its writer wants to be: up to the newest one, what isn't named never will be.
        """
        numbers = sorted(int(n) for n in self._names("log") if n.isdigit())
        views = [self.view(n) for n in numbers[-keep:]]
        named = {where.split("/")[1] for v in views for told in v.pointer["tables"].values() for where in told["parts"].values()}
        fs = self._fs()
        for n in numbers[:-keep]:
            fs.delete(self._path(f"log/{n:08d}"), False)
        for name in self._names("data"):
            if name not in named and numbers and int(name.split("-")[0]) <= numbers[-1]:
                fs.delete(self._path(f"data/{name}"), True)


"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Python pass gets at once while a table is kept: whole texts, so memory follows this number.
BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a folder under the temp
    folder, which driver and executors share there. Elsewhere that's an error.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "seekframe-checkpoints")


class Scratch:
    """Parquet tables of one run of an operator, deleted when dropped or when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, computed once, as a table that outlives any executor."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(BATCH_ROWS)
        self.spark.conf.set(BATCH_ROWS, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(BATCH_ROWS, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def finish(self, df: DataFrame) -> DataFrame:
        """``df`` kept, and all tables before it deleted: for results that are small beside what they were made of."""
        kept = self.keep(df)
        for n in range(1, self.count):
            self._delete(f"{self.root}/{n}")
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            self._delete(df._scratch_path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session is gone; nothing is left to delete with
            pass

    def _delete(self, where: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started.

    On a cluster the package is installed or sent with --py-files; this adds the
    driver's own copy to the workers' path, for sessions that share its disk.
    """
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in parts:
        env["PYTHONPATH"] = os.pathsep.join([here, *parts])

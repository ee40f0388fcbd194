"""Tables computed once and read several times, where every executor can read them."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one uses the temp folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "seekframe-kept")


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends here, so lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_path = path
    return kept


def drop(*frames: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._kept_path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; so have its uses of the table
        pass

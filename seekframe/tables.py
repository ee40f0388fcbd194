"""Loading of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: From this size on, a table that its files leave in fewer tasks than there are cores is dealt out again.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as cores, if it's worth it.

    Only small inputs have fewer: a file of one row group is read by one task. Columns and filters are still pushed
    below the exchange. Larger inputs come as they are.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, a file or a folder of part files."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

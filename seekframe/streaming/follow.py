"""Follow a stream of file versions into a project's index. The batch refresh does the work, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekframe.operators.index import Derive, refresh, terms
from seekframe.operators.store import Snapshots


def follow(
    versions: DataFrame, snapshots: Snapshots, analyse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, order: str = "version", derive: Derive | None = terms
) -> StreamingQuery:
    """Start a query that applies file versions to an index and ends when what's there is read.

    ``versions``: a stream of a scan's columns and ``order``; of a path's versions in a batch the latest counts. Each micro-batch
    rewrites the buckets of its paths, in every table of the index; vectors stay. A batch that is run again after a failure
    changes nothing: its hashes are the stored ones.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        latest = batch.withColumn("n", F.row_number().over(W.partitionBy("path").orderBy(F.desc(order)))).where("n = 1").drop("n", order)
        refresh(snapshots, latest, analyse, None, derive=derive, part=True)

    return versions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

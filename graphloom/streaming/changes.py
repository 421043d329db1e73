"""A stream of change events applied to the stored graph, a version for each micro-batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store

#: One event: a node (id, label, name, path) that is upserted or removed.
EVENTS = "id string, label string, name string, path string, action string, at timestamp"


def read(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", most_files).json(path)


def follow(events: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Starts a query that makes a version of each batch: a delta on the newest one. The checkpoint is the writer and the batch's
    number that of the change, so a batch that is repeated after its version was made is not applied again, whoever has
    made versions since; a new checkpoint goes on from whatever is the newest."""
    mark = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def one(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("id").agg(F.max_by(F.struct("label", "name", "path", "action"), "at").alias("e")).select("id", "e.*")
        actions = last.select("id", F.when(F.col("action") == "REMOVED", F.lit("REMOVED")).otherwise(F.lit("UPDATED")).alias("action"))
        store.apply(actions, last.drop("action"), writer=mark, number=epoch)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

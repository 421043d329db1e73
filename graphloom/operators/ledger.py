"""The ledger of impact snapshots: appended, touched when nothing changed, and kept to the newest of each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP = 50
SIGNATURE = ["repo", "node", "depth", "score", "direct", "indirect", "tests"]


def compact(snapshots: DataFrame) -> DataFrame:
    """One row for each signature: the first snapshot's id, the last one's time (null-safe: nulls are one value)."""
    return snapshots.groupBy(*SIGNATURE).agg(F.min_by("id", F.struct("ts", "id")).alias("id"), F.max("ts").alias("ts"))


def retain(snapshots: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest of each repository."""
    order = Window.partitionBy("repo").orderBy(F.desc("ts"), "id")
    return snapshots.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")


def history(snapshots: DataFrame, repo: str, node: str | None = None) -> DataFrame:
    out = snapshots.where(F.col("repo") == repo)
    return (out.where(F.col("node") == node) if node else out).orderBy(F.desc("ts"), "id")


def clear(snapshots: DataFrame, repo: str) -> DataFrame:
    return snapshots.where(~F.col("repo").eqNullSafe(repo))


def trend(snapshots: DataFrame) -> DataFrame:
    """Each entity's snapshots, oldest first, with the level as 0, 1 or 2 and its change."""
    order = Window.partitionBy("repo", "node").orderBy("ts", "id")
    value = F.when(F.col("score") == "HIGH", 2).when(F.col("score") == "MEDIUM", 1).when(F.col("score") == "LOW", 0)
    return snapshots.withColumn("value", value).withColumn("step", F.row_number().over(order)).withColumn("change", F.col("value") - F.lag("value").over(order))

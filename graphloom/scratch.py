"""Tables between the rounds of a loop, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set a local folder will do for a local master, as in tests; on a
    cluster that is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table that is read again: its lineage is cut, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """written(df), and how many of its rows are (all without what), counted while they are written."""
    seen = Observation()
    rows = F.count(F.lit(1)) if what is None else F.count(F.when(what, 1))
    table = written(df.observe(seen, rows.alias("n")), name)
    return table, seen.get["n"]

"""What several operators of this subpackage share: scratch tables, size-checked broadcasts, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its measured rows times its row bound stay below this.
BROADCAST_BYTES = 32 << 20
#: Rows that a Python worker holds at once.
ROWS = 2000
#: Rows of an Arrow batch between JVM and worker, which both hold it, where the session keeps Spark's default of 10,000.
BATCH_ROWS, BATCHES = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local one will do for a local master, as in tests; on
    a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is small enough to be broadcast."""
    return df.count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint for a written table whose size is checked; otherwise a shuffled join is left to the planner."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def small_batches(spark: SparkSession) -> None:
    """Batches of long texts would be tens of megabytes on both sides of each task; a session's own setting stays."""
    if spark.conf.get(BATCHES) == "10000":
        spark.conf.set(BATCHES, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Hands freed memory back to the system at a task's end, Arrow's pool first: idle Python workers are kept, and stay as
    large as they were at their largest otherwise. The C library may have no such call."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def add_column(df: DataFrame, into: str, kind: T.DataType, make: Callable[[dict], Iterable], reads: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """df and one more column, made by Arrow batches in one stage. make gets the read columns of a batch as lists of
    Python values and returns as many values; all other columns but those in drop pass through untouched,
    nulls included."""
    from pyspark.sql.pandas.types import to_arrow_type

    base = df.drop(into) if into not in reads else df
    schema = T.StructType([*[f for f in base.schema.fields if f.name != into and f.name not in drop], T.StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_type(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = pa.array(make({c: part.column(part.schema.get_field_index(c)).to_pylist() for c in reads}), type=arrow)
                rest = [c for c in part.schema.names if c != into and c not in drop]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), made], names=[*rest, into])
        trim()

    return base.mapInArrow(run, schema)

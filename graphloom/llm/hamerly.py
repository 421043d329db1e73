"""Centroid clustering of integer vectors with Hamerly's bounds.

A vector keeps an upper bound of the distance to its centroid and a lower bound of that to any other one. When centroids
move, the upper bound grows by its own centroid's drift and the lower one shrinks by the largest other drift. While the
upper bound is below the lower one, or below half the way to the next centroid, the assignment stands; else the upper bound
becomes exact, and if that is not enough, the vector is compared with all centroids in whole numbers. Bounds are rounded
outwards and compared strictly, so ties always reach the scan, where the smaller number wins.

Each round is one pass: a task writes its vectors with their bounds and, beside them, one row of sums for each centroid, so
no vector is shuffled, and the driver sees only sums over all tasks. The table of a round is the checkpoint of the next.

Defined results: a vector that is null, of another length, or has a null or non-finite component is left out; a
component whose floor(256 * x) lies beyond 2 ** 27 either way counts as that, so that distances fit in a long; a null id is
kept and is the last to start a centroid; repeated rows are vectors of their own; fewer vectors than centroids make as many
centroids as there are vectors; no vectors give no rows; columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, trim, written

CLUSTERS, ROUNDS, COMPONENTS, SEED = 40, 5, 64, 2
SCALE, LARGEST = 256.0, 1 << 27
#: Below this, products and sums of 64 components are exact in doubles.
EXACT = 1 << 21
#: Outward rounding of a bound.
MORE, LESS = 1 + 1e-12, 1 - 1e-12


def whole(df: DataFrame, vector: str, row_id: str, size: int = COMPONENTS) -> DataFrame:
    """(id, v): the vectors that count, as whole numbers."""
    id_type = df.schema[row_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            keep = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), size), False))
            flat = lists.filter(pa.array(keep)).flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls become NaN
            good = np.isfinite(x).all(axis=1)
            v = np.clip(np.floor(SCALE * x[good]), -LARGEST, LARGEST).astype(np.int64)
            rows = pa.array(np.flatnonzero(keep)[good])
            yield pa.RecordBatch.from_arrays([ids.take(rows), _lists(v)], names=["id", "v"])
        trim()

    schema = T.StructType([T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.LongType(), False))])
    return df.select(row_id, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def _lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid, exact."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def own(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((v - centroids[cluster]) ** 2).sum(1)


class Step:
    """What a round knows of the centroids: where they are, how far they moved, and half the way from each to the next."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        between = np.sqrt(squared(centroids, centroids).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        self.half = between.min(axis=1) / 2 * LESS
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(own(centroids, before, np.arange(len(before))).astype(np.float64)) * MORE
        self.moved, at = moved, int(moved.argmax())
        self.others = np.full(len(moved), moved[at])
        self.others[at] = np.delete(moved, at).max(initial=0.0)

    def scan(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = squared(v, self.centroids)
        cluster = d.argmin(axis=1)
        rows = np.arange(len(v))
        nearest = d[rows, cluster]
        d[rows, cluster] = np.iinfo(np.int64).max
        return cluster, np.sqrt(nearest.astype(np.float64)) * MORE, np.sqrt(d.min(axis=1).astype(np.float64)) * LESS

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Assignments and bounds after the move, and how many vectors were scanned."""
        cluster = cluster.copy()
        upper = (upper + self.moved[cluster]) * MORE
        lower = np.maximum(lower - self.others[cluster], 0.0) * LESS
        bar = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper >= bar)
        upper[open_] = np.sqrt(own(v[open_], self.centroids, cluster[open_]).astype(np.float64)) * MORE
        open_ = open_[upper[open_] >= bar[open_]]
        if len(open_):
            cluster[open_], upper[open_], lower[open_] = self.scan(v[open_])
        return cluster, upper, lower, len(open_)


def _round(rows: DataFrame, step: Step, first: bool, last: bool) -> DataFrame:
    """(id, v, cluster, upper, lower, n): vectors (n is null), and sums of each task's vectors (v) over n of them. In the last
    round v is empty, and n the squared distance."""
    k, id_type = len(step.centroids), rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(step.centroids), np.zeros(k, dtype=np.int64)
        names = ["id", "v", "cluster", "upper", "lower", "n"]
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if first:
                cluster, upper, lower = step.scan(v)
            else:
                cluster, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                cluster, upper, lower, _ = step.assign(v, cluster, upper, lower)
            if last:
                n, v = pa.array(own(v, step.centroids, cluster)), v[:, :0]
            else:
                n = pa.nulls(len(v), pa.int64())
                for c in np.unique(cluster):
                    part = v[cluster == c]
                    sums[c] += part.sum(axis=0)
                    counts[c] += len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(v), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), n], names=names)
        if not last:
            zero = pa.array(np.zeros(k))
            yield pa.RecordBatch.from_arrays([pa.nulls(k, arrow), _lists(sums), pa.array(np.arange(k, dtype=np.int32)), zero, zero, pa.array(counts)], names=names)
        trim()

    schema = T.StructType([T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.LongType(), False)), T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("n", T.LongType())])
    return rows.mapInArrow(run, schema)


def cluster(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = COMPONENTS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector, and the centroids after so many rounds. The first centroids are the vectors
    with the least SHA-256 of seed and id."""
    vectors = whole(df, vector, row_id, size)
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    first = named.orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).select("v").collect()
    if not first:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, size), dtype=np.int64)
    centroids, before, held = np.array([r["v"] for r in first], dtype=np.int64), None, None
    for k in range(rounds + 1):
        made = written(_round(vectors, Step(centroids, before), k == 0, k == rounds), "vectors")
        if held is not None:
            discard(held)
        held, before = made, centroids
        vectors = made.where("n IS NULL")
        if k < rounds:
            sums = made.where("n IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("v")[i]) for i in range(size))).alias("v")).collect()
            centroids = centroids.copy()
            for r in sums:
                if r["n"]:
                    centroids[r["cluster"]] = np.array(r["v"], dtype=np.int64) // r["n"]
    return held.select("id", "cluster", F.col("n").alias("distance")), centroids


def report(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """One row a vector: its cluster, distance, the sums of distances over the cluster and over all, and its centroid's digest."""
    found, centroids = cluster(df, vector, row_id)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = found.sparkSession.createDataFrame([(c, s, digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(known), "cluster")  # a row a cluster
    return out.select(F.col("id").alias(row_id), "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")

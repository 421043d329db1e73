"""Versions of a graph as one whole state and the deltas after it.

A version is a small file that lists folders of Parquet: a whole state first, then deltas in order. Folders are written once,
under names of their own, before a version lists them, and never again; the version's file is made in one exclusive step. So a
reader sees a version whole or not at all, a run that fails leaves nothing that anyone reads, and two writers cannot make
the same version. A delta holds added or changed rows, and removed ones as tombstones; applying a change writes only these.

Reading puts a delta's rows in place of earlier ones with their key: the last row of each key among the deltas, and the
whole state without these keys. So the whole state is not shuffled while the deltas' keys are few, and compact() writes a new
whole state when they are not.

Defined results: a node that is removed and was not there, or added and removed in one change, is not there; a change whose
writer and number are known already is not applied again; an empty change makes a version like the one before; an edge that
is both removed and added stays; null ids and ends are no keys and are left out; columns that a change lacks are null.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = ["src", "type", "dst"]
#: Edges that no change removes: a commit's history.
KEPT = ("MODIFIES", "AUTHORED_BY")


class Store:
    """Versions of a graph below a path that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # versions

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        fs, at = self._at("versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), reverse=True)

    def manifest(self, version: int) -> dict | None:
        """What a version lists; None for a file that is not there, or not yet whole."""
        fs, at = self._at(f"versions/v{version}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()
        return found

    def version(self) -> int | None:
        """The newest whole version."""
        return next((n for n in self._numbers() if self.manifest(n)), None)

    def _newest(self) -> tuple[int, dict]:
        v = self.version()
        if v is None:
            raise ValueError("nothing is stored yet")
        return v, self.manifest(v)

    def _mark(self, version: int, parts: list[str], writers: dict[str, int]) -> int:
        fs, at = self._at(f"versions/v{version}")
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as e:
            raise ValueError(f"version {version} is there already, or was made meanwhile") from e
        stream.write(bytearray(json.dumps({"parts": parts, "writers": writers}).encode()))
        stream.close()
        return version

    def _written(self, nodes: DataFrame, edges: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        nodes.write.parquet(f"{self.path}/{name}/nodes")
        edges.write.parquet(f"{self.path}/{name}/edges")
        return name

    def _next(self) -> int:
        return max(self._numbers(), default=-1) + 1

    # whole states

    def promote(self, nodes: DataFrame, edges: DataFrame, version: int | None = None, writer: str | None = None, number: int = 0) -> int:
        """Writes a whole state and makes it a version, the next one or a given one that is not there yet."""
        if version is not None and version in self._numbers():
            raise ValueError(f"version {version} is there already, or was made meanwhile")
        newest = self.version()
        writers = dict(self.manifest(newest)["writers"]) if newest is not None else {}
        if writer is not None:
            writers[writer] = number
        return self._mark(self._next() if version is None else version, [self._written(nodes, edges.select(*EDGE))], writers)

    def compact(self) -> int:
        """The newest version as a whole state, as a version of its own."""
        v, found = self._newest()
        return self._mark(self._next(), [self._written(*self.read(v))], found["writers"])

    def expire(self, keep: int = 1) -> int:
        """Removes all but the newest versions and what only removed ones list; how many folders went. Not while older versions
        are read."""
        numbers = [n for n in self._numbers() if self.manifest(n)]
        used = {p for n in numbers[:keep] for p in self.manifest(n)["parts"]}
        gone = {p for n in numbers[keep:] for p in self.manifest(n)["parts"]} - used
        for name in [*(f"versions/v{n}" for n in numbers[keep:]), *gone]:  # versions first: none may list what is not there
            fs, at = self._at(name)
            fs.delete(at, True)
        return len(gone)

    # reading

    def _merged(self, parts: list[str], what: str, key: list[str]) -> DataFrame:
        read = lambda part: self.spark.read.parquet(f"{self.path}/{part}/{what}")
        whole = read(parts[0])
        if len(parts) == 1:
            return whole
        deltas = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(p).withColumn("seq_", F.lit(k)) for k, p in enumerate(parts[1:])])
        rest = [c for c in deltas.columns if c not in key and c != "seq_"]
        last = deltas.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq_").alias("last")).select(*key, "last.*")
        return whole.join(last.select(*key), key, "left_anti").unionByName(last.where("NOT gone_").drop("gone_"), allowMissingColumns=True)

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a version, the newest one without a number."""
        found = self._newest()[1] if version is None else self.manifest(version)
        if found is None:
            raise ValueError(f"no version {version}")
        return self._merged(found["parts"], "nodes", ["id"]), self._merged(found["parts"], "edges", EDGE)

    # changes

    def apply(self, actions: DataFrame, new_nodes: DataFrame, edge_changes: DataFrame | None = None, writer: str | None = None, number: int = 0) -> int:
        """The version after a change: actions (id, action), rows of what is ADDED or UPDATED, and edges (src, type, dst, action)
        that are ADDED or REMOVED. What a commit modifies is not removed, nor are a commit's edges; edges of removed nodes go, and
        edges without both ends are not added. A change whose writer made one of this number or a later one is not
        applied again."""
        version, found = self._newest()
        if writer is not None and found["writers"].get(writer, -1) >= number:
            return version
        nodes, edges = self.read(version)
        held = edges.where("type = 'MODIFIES'").select(F.col("dst").alias("id"))
        gone = actions.where("action = 'REMOVED' AND id IS NOT NULL").select("id").distinct().join(held, "id", "left_anti")
        fresh = new_nodes.join(actions.where("action IN ('ADDED', 'UPDATED')").select("id"), "id", "left_semi").dropDuplicates(["id"])
        node_rows = fresh.withColumn("gone_", F.lit(False)).unionByName(gone.withColumn("gone_", F.lit(True)), allowMissingColumns=True)
        lost = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")).select(*EDGE)
        edge_rows = lost.withColumn("gone_", F.lit(True))
        if edge_changes is not None:
            added = edge_changes.where("action = 'ADDED'").select(*EDGE).distinct()
            ends = added.select(F.col("src").alias("id")).unionAll(added.select("dst")).distinct()
            known = nodes.select("id").join(ends, "id", "left_semi").join(gone, "id", "left_anti").unionAll(fresh.select("id")).distinct()
            added = added.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*EDGE)
            removed = edge_changes.where((F.col("action") == "REMOVED") & ~F.col("type").isin(*KEPT)).select(*EDGE)
            # a row a key, added before removed
            edge_rows = edge_rows.unionAll(removed.withColumn("gone_", F.lit(True))).unionAll(added.withColumn("gone_", F.lit(False)))
        edge_rows = edge_rows.groupBy(*EDGE).agg(F.bool_and("gone_").alias("gone_"))
        writers = {**found["writers"], **({writer: number} if writer is not None else {})}
        return self._mark(self._next(), [*found["parts"], self._written(node_rows, edge_rows)], writers)

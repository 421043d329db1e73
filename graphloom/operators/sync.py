"""Incremental synchronisation: file and graph deltas, and their application. Versions are in store."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where an entity has several actions, the first of these holds; an entity that is added and removed has none.
PRIORITY = {"ADDED": 0, "UPDATED": 1, "REMOVED": 2}


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of two states (path, hash): ADDED, CHANGED, REMOVED or UNCHANGED."""
    both = old.select("path", F.col("hash").alias("was"), F.lit(True).alias("o")).join(new.select("path", F.col("hash").alias("now"), F.lit(True).alias("n")), "path", "full_outer")
    status = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "REMOVED").when(F.col("was").eqNullSafe(F.col("now")), "UNCHANGED").otherwise("CHANGED")
    return both.select("path", status.alias("status"))


def graph_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action) of two states of nodes: equal properties (as JSON by sorted names) make no row."""
    props = lambda df: F.to_json(F.struct(*sorted(c for c in df.columns if c != "id")))
    both = old.select("id", props(old).alias("was"), F.lit(True).alias("o")).join(new.select("id", props(new).alias("now"), F.lit(True).alias("n")), "id", "full_outer")
    action = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "UPDATED")
    return both.select("id", action.alias("action")).where("action IS NOT NULL")


def renamed(changed: DataFrame) -> DataFrame:
    """(path, status) of a change set (path, old_path, status): a rename is a removal and an addition."""
    gone = changed.where("status = 'RENAMED' AND old_path IS NOT NULL").select(F.col("old_path").alias("path"), F.lit("DELETED").alias("status"))
    here = changed.select("path", F.when(F.col("status") == "RENAMED", F.lit("ADDED")).otherwise(F.col("status")).alias("status"))
    return here.unionAll(gone).distinct()


def old_state(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is stored of some paths (path): their files and the symbols in these, and the edges that leave them."""
    files = nodes.join(paths.select("path"), "path", "left_semi").where("label = 'File'").select("id")
    inside = edges.where("type = 'CONTAINS'").join(files.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    ids = files.unionAll(inside).distinct()
    return nodes.join(ids, "id", "left_semi"), edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "type", "dst")


def stored_hashes(nodes: DataFrame, contained: DataFrame, repo: str) -> DataFrame:
    """(path, hash) of a repository's files that have one. contained: (root, id), as of Graph.contained()."""
    ids = contained.where(F.col("root") == repo).select("id").distinct()
    return nodes.where("label = 'File' AND hash IS NOT NULL").join(ids, "id", "left_semi").select("path", "hash")


def edge_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["src", "type", "dst"]
    added = new.join(old.select(*keys), keys, "left_anti").withColumn("action", F.lit("ADDED"))
    removed = old.join(new.select(*keys), keys, "left_anti").withColumn("action", F.lit("REMOVED"))
    return added.select(*keys, "action").unionAll(removed.select(*keys, "action"))


def merge_actions(actions: DataFrame) -> DataFrame:
    """(id, action) of several deltas in one: the action of the highest priority; added and removed cancel out."""
    rank = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    sums = actions.groupBy("id").agg(F.min_by("action", F.try_element_at(rank, F.col("action"))).alias("action"), F.collect_set("action").alias("s"))
    return sums.where(~(F.array_contains("s", "ADDED") & F.array_contains("s", "REMOVED"))).select("id", "action")


def apply(nodes: DataFrame, edges: DataFrame, delta: DataFrame, new_nodes: DataFrame, edge_changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next version of nodes and edges. Edges of commits are never dropped, nor entities that a commit modifies."""
    keys = ["src", "type", "dst"]
    held = edges.where(F.col("type") == "MODIFIES").select(F.col("dst").alias("id")).distinct()
    gone = delta.where("action = 'REMOVED'").select("id").join(held, "id", "left_anti")
    fresh = delta.where("action IN ('ADDED', 'UPDATED')").select("id")
    next_nodes = nodes.join(gone.unionAll(fresh), "id", "left_anti").unionByName(new_nodes.join(fresh, "id", "left_semi"), allowMissingColumns=True)
    lost = edge_changes.where("action = 'REMOVED'").select(*keys)
    kept = edges.join(lost, keys, "left_anti").unionByName(edges.where(F.col("type").isin("MODIFIES", "AUTHORED_BY")).join(lost, keys, "left_semi"))
    next_edges = kept.select(*keys).unionAll(edge_changes.where("action = 'ADDED'").select(*keys)).distinct()
    ids = next_nodes.select("id")
    next_edges = next_edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return next_nodes, next_edges.select(*keys)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new in place of old rows with their key; of several new ones the last by column at."""
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("at")))).where("__n = 1").drop("__n", "at")
    return old.join(last.select(*key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def remove_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """nodes and edges without the files of paths (path), their symbols and tests, and edges of these; how many nodes went."""
    gone = nodes.join(paths, "path", "left_semi").select("id")
    inside = edges.where("type = 'CONTAINS'").join(gone.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    gone = gone.unionAll(inside).distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left, nodes.join(gone, "id", "left_semi").count()


def activate(repositories: DataFrame, repo: str) -> DataFrame:
    return repositories.withColumn("active", F.col("id") == repo)


def purge(sessions: DataFrame, now: str) -> DataFrame:
    """Sessions that have not expired at a time."""
    return sessions.where(F.col("expires_at") >= F.lit(now).cast("timestamp"))


class Runs:
    """Synchronisations of repositories on the driver: one at a time of each, so many at once in all. A run is QUEUED, RUNNING,
    then DONE, FAILED (after as many tries as allowed) or CANCELLED; a request for a repository that has a run under way
    joins it."""

    def __init__(self, work: Callable[[str, threading.Event], None], at_once: int = 3, tries: int = 3):
        self._work, self._tries = work, tries
        self._pool = ThreadPoolExecutor(max_workers=at_once)
        self._lock = threading.Lock()
        self._runs: dict[str, dict] = {}

    def request(self, repo: str) -> Future:
        with self._lock:
            run = self._runs.get(repo)
            if run and run["state"] in ("QUEUED", "RUNNING"):
                return run["future"]
            run = self._runs[repo] = {"state": "QUEUED", "stop": threading.Event(), "tries": 0, "error": None}
            run["future"] = self._pool.submit(self._run, repo, run)
            return run["future"]

    def cancel(self, repo: str) -> bool:
        """Whether there was a run to be cancelled; work sees its event set, and a queued run never starts."""
        with self._lock:
            run = self._runs.get(repo)
            if not run or run["state"] not in ("QUEUED", "RUNNING"):
                return False
            run["stop"].set()
            return True

    def state(self, repo: str) -> tuple[str, int, str | None]:
        """(state, tries, the last error); IDLE for a repository that was never asked for."""
        with self._lock:
            run = self._runs.get(repo)
            return (run["state"], run["tries"], run["error"]) if run else ("IDLE", 0, None)

    def _run(self, repo: str, run: dict) -> None:
        while not run["stop"].is_set() and run["tries"] < self._tries:
            with self._lock:
                run["state"], run["tries"] = "RUNNING", run["tries"] + 1
            try:
                self._work(repo, run["stop"])
                with self._lock:
                    run["state"] = "CANCELLED" if run["stop"].is_set() else "DONE"
                return
            except Exception as e:  # the error is kept for state(); the next try may do better
                with self._lock:
                    run["error"] = f"{type(e).__name__}: {e}"
        with self._lock:
            run["state"] = "CANCELLED" if run["stop"].is_set() else "FAILED"

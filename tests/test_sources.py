"""Sources, stored states and small graphs: tarballs, git, captured pages, hashes, sessions, bounds, empty graphs."""

import io
import json
import subprocess
import tarfile

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import deps, guardrails, history, impact, intel, paths, records, sync
from graphloom.sources import repository


def test_tarball_and_clone(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name, text in (("o-r-1/src/a.ts", "class A {}"), ("o-r-1/README.md", "hi")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "t").mkdir()
    root = repository.source(str(tmp_path / "x.tar.gz"), str(tmp_path / "t"))
    assert {r["path"] for r in repository.files(spark, root).collect()} == {"src/a.ts", "README.md"}
    assert [r["path"] for r in repository.files(spark, root, most=1).collect()] == ["README.md"]
    with tarfile.open(tmp_path / "evil.tar", "w") as tar:
        tar.addfile(tarfile.TarInfo("../out.txt"))
    (tmp_path / "u").mkdir()
    with pytest.raises(tarfile.TarError):
        repository.source(str(tmp_path / "evil.tar"), str(tmp_path / "u"))
    assert repository.source(str(tmp_path), "unused") == str(tmp_path)


def test_git_log(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(3):
        (tmp_path / "f").write_text(str(k))
        run("add", "f")
        run("commit", "-qm", f"change {k}")
    rows = repository.log(str(tmp_path))
    assert [r[3] for r in rows] == ["change 2", "change 1", "change 0"] and rows[0][1] == "N" and len(rows[0][0]) == 40
    assert repository.behind(str(tmp_path), "HEAD~2") == 2 and len(repository.log(str(tmp_path), most=1)) == 1


def test_captured_pages(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text(json.dumps([{"sha": "s", "commit": {"message": "m", "author": {"name": "N", "date": "2024-01-01T00:00:00Z"}}, "author": {"login": "n"}, "more": 1}, {"sha": "t"}]))
    got = repository.payloads(spark, str(tmp_path / "c"), repository.COMMITS)
    assert {(r["sha"], r["commit"] and r["commit"]["author"]["date"]) for r in got.collect()} == {("s", "2024-01-01T00:00:00Z"), ("t", None)}
    for schema in (repository.COMMIT_FILES, repository.PULLS, repository.ISSUES, repository.REPOSITORIES):
        assert repository.payloads(spark, str(tmp_path / "c"), schema).count() == 2


def test_hashes(spark):
    rows = [(b"abc", 3), (b"x", repository.MAX_PARSED + 1), (None, 3), (b"", 0)]
    df = spark.createDataFrame(rows, "content binary, size long").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    got = [r[0] for r in df.select(repository.content_hash(F.col("content"), F.col("size"), F.col("at"))).collect()]
    assert got[0].startswith("ba7816bf") and got[1] not in (got[0], got[3]) and len(got[1]) == 64 and got[2] == "error:" and got[3].startswith("e3b0c442")


def test_sessions_and_repositories(spark):
    repos = spark.createDataFrame([("a", True), ("b", None)], "id string, active boolean")
    assert {tuple(r) for r in sync.activate(repos, "b").collect()} == {("a", False), ("b", True)}
    sessions = spark.createDataFrame([("x", "2024-01-01"), ("y", "2024-01-03")], "id string, e string").select("id", F.col("e").cast("timestamp").alias("expires_at"))
    assert [r["id"] for r in sync.purge(sessions, "2024-01-02").collect()] == ["y"]


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, label, i, f"src/{i}") for i, label in nodes], "id string, label string, name string, path string")
    for c in ("title", "sha", "username", "message", "language", "framework"):
        n = n.withColumn(c, F.lit(None).cast("string"))
    return Graph.loaded(n.withColumn("active", F.lit(None).cast("boolean")).withColumn("ts", F.lit(None).cast("timestamp")), spark.createDataFrame(edges, "src string, type string, dst string"))


def test_long_cycles_and_limits_of_paths(spark):
    ring = [f"file:{k}" for k in range(10)]
    edges = [(a, "CALLS", b) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)] + [("file:x", "IMPORTS", f) for f in ring] + [("file:x", "IMPORTS", None)]
    g = graph(spark, [(f, "File") for f in [*ring, "file:x"]], edges)
    scope = guardrails.Selector("src/**")
    assert guardrails.forbidden_cycles(g, scope, ("IMPORTS", "CALLS"), 10).first()["length"] == 10
    assert guardrails.forbidden_cycles(g, scope, ("IMPORTS", "CALLS"), 9).count() == 0
    root = spark.createDataFrame([("file:x",)], "id string")
    assert paths.expand(g.keyed("IMPORTS"), root, 1).count() == 10 and paths.expand(g.keyed("IMPORTS"), root, 1, per_root=4).count() == 4
    assert {r["node"] for r in paths.traversal(g.keyed("IMPORTS"), root, 1, 3).collect()} == {"file:0", "file:1", "file:2"}
    near = paths.distances(g.e("CALLS"), spark.createDataFrame([("file:0",)], "id string"), 10)
    assert {(r["node"], r["hops"]) for r in near.collect()} == {(f"file:{k or 0}", k or 10) for k in range(10)}
    assert impact.impact(g, spark.createDataFrame([("file:3",)], "id string"), 1, 1).count() == 1


def test_a_hub_costs_its_edges(spark):
    """Levels of 60 nodes, each joined with all of the next: 60 ** 3 trails, but few nodes."""
    edges = [(f"file:{a}:{i}", "CALLS", f"file:{a + 1}:{j}") for a in range(3) for i in range(60) for j in range(60)]
    g = graph(spark, [(f"file:{a}:{i}", "File") for a in range(4) for i in range(60)], edges)
    found = paths.distances(g.e("CALLS"), spark.createDataFrame([("file:0:0",)], "id string"), 4)
    assert {(r["hops"], r["n"]) for r in found.groupBy("hops").agg(F.count("*").alias("n")).collect()} == {(1, 60), (2, 60), (3, 60)}


def test_records(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 5), (None, "c", 7)], "id long, name string, n int")
    assert records.count(df) == 3 and records.count(df, {"name": None}) == 1 and records.count(df, {"id": [1, 2]}) == 2
    assert [r["id"] for r in records.find(df, {"id": [1, 2]}, [F.desc("id")], 1).collect()] == [2]
    assert {tuple(r) for r in records.updated(df, {"name": None}, {"n": 9, "name": "x"}).collect()} == {(1, "a", None), (2, "x", 9), (None, "c", 7)}
    assert {r["id"] for r in records.deleted(df, {"n": None}).collect()} == {2, None}
    new = spark.createDataFrame([(None, "z"), (4, "q")], "id long, name string")
    assert {tuple(r) for r in records.upserted(df, new, ["id"]).collect()} == {(1, "a", None), (2, None, 5), (None, "z", None), (4, "q", None)}
    assert records.count(df.limit(0)) == 0 and records.find(df.limit(0), {"id": 1}).count() == 0


def test_force_layout(spark):
    found = spark.createDataFrame([(x, 0) for x in "abcdef"], "id string, hops int")
    edges = spark.createDataFrame([("a", "CALLS", "b"), ("b", "CALLS", "c"), ("c", "CALLS", "a"), ("a", "CALLS", "a"), ("d", "CALLS", "zz")], "src string, type string, dst string")
    one, two = ({r["id"]: (r["x"], r["y"]) for r in paths.force(found, edges).collect()} for _ in range(2))
    far = lambda p, a, b: ((p[a][0] - p[b][0]) ** 2 + (p[a][1] - p[b][1]) ** 2) ** 0.5
    assert one == two and far(one, "a", "b") < far(one, "a", "e") and min(far(one, a, b) for a in one for b in one if a < b) > 20
    assert paths.force(found.limit(0), edges).count() == 0
    with pytest.raises(ValueError):
        paths.force(spark.range(501).select(F.col("id").cast("string")), edges)


def test_empty_graph(spark):
    g = graph(spark, [], [])
    root = spark.createDataFrame([("file:a",), (None,)], "id string")
    for df in (deps.class_dependencies(g), deps.relationship_summary(g), deps.incident(g, "file:a"), deps.search(g, "x", ["File"], 5), history.counts(g), history.bundle(g, root), intel.orphans(g), intel.god_modules(g), paths.cycles(g.keyed("IMPORTS")), impact.impact(g, root, 2), impact.tests_for_change(g, root, 2), deps.tests_for(g, "file:a")):
        assert df.count() == 0
    assert impact.change_score(g, root.limit(0), 2).first()["level"] == "LOW" and intel.workspace(g).first()["files"] == 0

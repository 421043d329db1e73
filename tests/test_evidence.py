"""Evidence, checks of explanations, gate, report, history load, scoped extraction and assembled graphs."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from graphloom.functions import parse
from graphloom.graph import Graph
from graphloom.operators.store import Store
from graphloom.operators import deps, evidence, guardrails, history, impact, ingest, intel, paths, sync, testsel
from graphloom.plans.projection import load


def test_explanations(spark):
    good = {"summary": " A  text ", "keyFindings": ["one"], "evidenceReferences": ["E1", "E2"], "confidence": "high"}
    cases = [
        (json.dumps(good), None),
        ("```json\n" + json.dumps(good) + "\n```", None),
        (json.dumps({"summary": "x", "confidence": "medium"}), None),
        (json.dumps({"summary": "x", "confidence": "medium", "keyFindings": []}), None),
        (None, "not a JSON object"),
        ("", "not a JSON object"),
        ("{", "not a JSON object"),
        ("[1]", "not a JSON object"),
        (json.dumps(good | {"summary": 3}), "summary must be a text"),
        (json.dumps(good | {"summary": "  "}), "summary is empty"),
        (json.dumps(good | {"summary": "x" * 801}), "summary is too long"),
        (json.dumps(good | {"keyFindings": ["x"] * 7}), "keyFindings must be a list of at most 6 texts"),
        (json.dumps(good | {"keyFindings": "x"}), "keyFindings must be a list of at most 6 texts"),
        (json.dumps(good | {"keyFindings": [1]}), "keyFindings must be a list of at most 6 texts"),
        (json.dumps(good | {"directImpact": ["x" * 201]}), "directImpact holds a text that is too long"),
        (json.dumps(good | {"evidenceReferences": ["X1"]}), "a reference is no evidence id"),
        (json.dumps(good | {"evidenceReferences": ["E9"]}), "a reference is unknown"),
        (json.dumps(good | {"confidence": "sure"}), "confidence must be high, medium or insufficient"),
        (json.dumps({k: v for k, v in good.items() if k != "confidence"}), "confidence must be high, medium or insufficient"),
    ]
    df = spark.createDataFrame([(k, "r", t) for k, (t, _) in enumerate(cases)], "k int, root string, text string")
    known = spark.createDataFrame([("r", "E1"), ("r", "E2"), ("s", "E9")], "root string, id string")
    got = {r["k"]: r for r in evidence.checked(df, known).collect()}
    assert {k: r["error"] for k, r in got.items()} == {k: e for k, (_, e) in enumerate(cases)}
    assert got[0]["explanation"]["summary"] == "A  text" and got[0]["explanation"]["evidenceReferences"] == ["E1", "E2"] and got[2]["explanation"]["keyFindings"] == []


def test_shortened(spark):
    df = spark.createDataFrame([("  a \n\t b ",), ("x" * 200,), ("y" * 118 + " zzzz",), (None,)], "t string")
    assert [r[0] for r in df.select(evidence.shortened(F.col("t"))).collect()] == ["a b", "x" * 119 + "…", "y" * 118 + "…", ""]


def test_gate_and_report(spark, sf_dir):
    g = load(spark, sf_dir)
    assert evidence.gate(g, [])[0] == 2
    code, text = evidence.gate(g, ["file:7", "a/no/such.ts"], 2)
    assert code == 0 and "changed: 1" in text and "not in the graph: a/no/such.ts" in text
    level = impact.change_score(g, spark.createDataFrame([("file:7",)], "id string"), 2).first()["level"]
    assert evidence.gate(g, ["file:7"], 2, level)[0] == 1
    if level != "HIGH":
        assert evidence.gate(g, ["file:7"], 2, "HIGH")[0] == 0
    made = evidence.report(g, "file:7", 2)
    assert made.startswith("# Impact of Supplier") and "## Direct (" in made and "## History" in made
    parts = evidence.response(g, spark.createDataFrame([("file:7",)], "id string"), 2)
    assert parts["roots"].count() == parts["scores"].count() == 1 and parts["history"].where("kind = 'commit'").count() <= 10


def test_caps_of_entries_and_files(spark):
    nodes = [("dir:d", "Directory"), ("file:a", "File"), *((f"fn:{k:04}", "Function") for k in range(600))]
    edges = [("dir:d", "CONTAINS", "file:a"), *(("file:a", "CONTAINS", f"fn:{k:04}") for k in range(600))]
    g = graph(spark, nodes, edges)
    root = lambda x: spark.createDataFrame([(x,)], "id string")
    assert impact.entries(g, root("file:a")).count() == impact.entries(g, root("dir:d")).count() == 500
    assert impact.entries(g, root("dir:d"), None).count() == 600 and impact.entries(g, root("dir:d")).agg(F.max("id")).first()[0] == "fn:0499"
    with pytest.raises(ValueError):
        impact.blast_radius(g, spark.range(101).select(F.concat(F.lit("file:"), "id").alias("id")))


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, label, i, f"src/{i}") for i, label in nodes], "id string, label string, name string, path string")
    for c in ("title", "sha", "username", "message", "language", "framework"):
        n = n.withColumn(c, F.lit(None).cast("string"))
    return Graph.loaded(n.withColumn("active", F.lit(None).cast("boolean")).withColumn("ts", F.lit(None).cast("timestamp")), spark.createDataFrame(edges, "src string, type string, dst string"))


def test_classes_are_told_by_label(spark):
    """Classes with the ids that the extractor mints."""
    nodes = [("file:a", "File"), ("file:b", "File"), ("fn:a:A", "Class"), ("fn:b:B", "Class"), ("fn:a:A.m", "Function"), ("fn:b:B.n", "Function")]
    edges = [("file:a", "CONTAINS", "fn:a:A"), ("file:b", "CONTAINS", "fn:b:B"), ("file:a", "CONTAINS", "fn:a:A.m"), ("file:b", "CONTAINS", "fn:b:B.n"), ("fn:a:A.m", "CALLS", "fn:b:B.n")]
    g = graph(spark, nodes, edges)
    assert [tuple(r) for r in deps.class_dependencies(g).collect()] == [("fn:a:A", "fn:b:B", "CALLS", "fn:b:B.n")]
    assert [r["class"] for r in intel.core_components(g, 5).collect()] == ["fn:b:B"]
    assert [(r["id"], r["label"], r["via"]) for r in deps.dependencies(g, "fn:a:A").collect()] == [("fn:b:B", "Class", "fn:b:B.n")]
    assert deps.dependencies(g, "none").count() == 0 and deps.dependencies(g, "fn:b:B", "in").first()["id"] == "fn:a:A"
    again = Graph.loaded(g.nodes.unionAll(g.nodes.withColumn("name", F.lit("zzz"))), g.edges)
    assert again.nodes.where("name = 'zzz'").count() == 0 and again.nodes.count() == 6


def test_history_load(spark):
    commits = spark.createDataFrame([(0, "s0", "m0", "2024-01-03T00:00:00Z", "ann", "Ann"), (1, "s1", None, "2024-01-02T00:00:00Z", None, None), (2, "s2", "m2", "bad", "ann", "Ann L"), (3, "s3", "m3", None, "bob", None), (4, "", "x", None, "c", "C"), (None, None, None, None, None, None)], "place int, sha string, message string, date string, login string, author string")
    details = spark.createDataFrame([("s0", "a.ts"), ("s0", "gone.ts"), ("s2", "a.ts"), ("s2", "a.ts"), ("s3", "a.ts")], "sha string, filename string")
    pulls = spark.createDataFrame([(5, "P", "2024-01-01T00:00:00Z", "s0", "s1"), (6, None, None, "none", None), (0, "no", None, None, None)], "number long, title string, created string, merge_sha string, head_sha string")
    issues = spark.createDataFrame([(5, "I", None), (9, "J", None)], "number long, title string, created string")
    files = spark.createDataFrame([("a.ts",)], "path string")
    nodes, edges = history.load(commits, details, pulls, issues, files, recent=3, detailed=2)
    assert {r["id"] for r in nodes.collect()} == {"commit:s0", "commit:s1", "commit:s2", "dev:ann", "pr:5", "pr:6", "issue:5", "issue:9"}
    assert {tuple(r) for r in edges.collect()} == {("commit:s0", "AUTHORED_BY", "dev:ann"), ("commit:s2", "AUTHORED_BY", "dev:ann"), ("commit:s0", "MODIFIES", "file:a.ts"), ("pr:5", "CONTAINS", "commit:s0"), ("pr:5", "CONTAINS", "commit:s1"), ("issue:5", "RELATED_TO", "pr:5")}
    assert nodes.where("id = 'commit:s2' AND ts IS NULL").count() == 1


CASES = {
    "TypeScript": ("import D, { a as b, type c } from './x';\nimport * as ns from './y';\nexport abstract class K<T> extends ns.Base<T> implements I, J<U> {\n  private f = 1;\n  static async m(x: number): Promise<void> { b(); this.q(); ns.go(); }\n}\ninterface I extends Q {}\nenum E { A }\ntype T = string;\nconst h = (x) => { K.m(1); };\n// no(); \"no()\"\ndescribe('d', () => { it('does \"x\"', () => h(2)); });\n",
        {("class", "K"), ("method", "K.m"), ("interface", "I"), ("enum", "E"), ("type", "T"), ("function", "h"), ("extends", "K", "ns.Base"), ("implements", "K", "I"), ("implements", "K", "J"), ("extends", "I", "Q"), ("call", "b", "K.m"), ("call", "ns.go", "K.m"), ("call", "K.m", "h"), ("import", "D", "./x"), ("import", "b", "./x"), ("import", "ns", "./y"), ("test", "d › does \"x\"")}, {("call", "no", "h")}),
    "JavaScript": ("const { p, q: r } = require('./z');\nclass A extends B { go() { p(); } }\nfunction* gen() { r(); }\n", {("class", "A"), ("method", "A.go"), ("function", "gen"), ("extends", "A", "B"), ("call", "p", "A.go"), ("call", "r", "gen"), ("import", "p", "./z"), ("import", "r", "./z")}, set()),
    "Python": ("from .u import t as s\nimport os.path as op\nclass A(B, object):\n    def _p(self):\n        s(); op.join()\n    @staticmethod\n    def st(): pass\n    def test_it(self):\n        def inner(): t2()\n        inner()\n", {("class", "A"), ("method", "A._p"), ("method", "st"), ("method", "A.test_it"), ("function", "inner"), ("extends", "A", "B"), ("call", "s", "A._p"), ("call", "op.join", "A._p"), ("call", "t2", "inner"), ("call", "inner", "A.test_it"), ("import", "s", ".u"), ("import", "op", "os.path"), ("test", "A › test_it")}, {("extends", "A", "object")}),
    "Go": ("package m\nimport (\n  f \"fmt\"\n  \"x/y\"\n)\ntype T struct { N }\ntype R interface { Do() }\nfunc (t *T) Do() { y.Run() }\nfunc Run[K any](k K) { Do() }\n", {("struct", "T"), ("interface", "R"), ("method", "T.Do"), ("function", "Run"), ("call", "y.Run", "T.Do"), ("call", "Do", "Run"), ("import", "f", "fmt"), ("import", "y", "x/y")}, set()),
    "Java": ("import a.b.C;\npublic class M extends N implements P, Q {\n  public M() { init(); }\n  private static List<String> go(int a) throws X { C.run(); return null; }\n}\ninterface Z extends Y {}\nenum E { A }\n", {("class", "M"), ("method", "M.M"), ("method", "M.go"), ("interface", "Z"), ("enum", "E"), ("extends", "M", "N"), ("implements", "M", "P"), ("implements", "M", "Q"), ("extends", "Z", "Y"), ("call", "init", "M.M"), ("call", "C.run", "M.go"), ("import", "C", "a.b.C")}, set()),
    "Rust": ("use crate::x::Y;\npub struct S;\nenum E { A }\ntrait Tr { fn t(&self) { u(); } }\nimpl Tr for S { fn t(&self) { v('\\'', 'a'); } }\nimpl S { pub fn n() -> S { Y::make() } }\nmod k { pub fn f<'a>(x: &'a str) { w!(x); } }\n", {("struct", "S"), ("enum", "E"), ("trait", "Tr"), ("method", "Tr.t"), ("method", "S.t"), ("method", "S.n"), ("module", "k"), ("function", "f"), ("implements", "S", "Tr"), ("call", "u", "Tr.t"), ("call", "v", "S.t"), ("call", "Y.make", "S.n"), ("call", "w", "f"), ("import", "Y", "crate::x::Y")}, set()),
    "PHP": ("<?php\nuse App\\X;\n# no()\nclass P extends Q implements R { public function m() { $this->a(); X::b(); } }\nfunction top() { go(); }\ninterface W {}\n", {("class", "P"), ("method", "P.m"), ("function", "top"), ("interface", "W"), ("extends", "P", "Q"), ("implements", "P", "R"), ("call", "X.b", "P.m"), ("call", "go", "top"), ("import", "X", "App\\X")}, set()),
    "C#": ("using System.Text;\npublic class C : D, IE {\n  public C() { Init(); }\n  internal async Task<int> M<T>(int a) => await F.Go(a);\n  ~C() { }\n}\nrecord R(int A);\nstruct S { }\ninterface I { }\nenum E { A }\n", {("class", "C"), ("class", "R"), ("struct", "S"), ("interface", "I"), ("enum", "E"), ("method", "C.C"), ("method", "C.M"), ("extends", "C", "D"), ("extends", "C", "IE"), ("call", "Init", "C.C"), ("import", "Text", "System.Text")}, set()),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_scoped_extraction(language):
    text, want, never = CASES[language]
    got = set()
    for r in parse.rows_of("f", language, text):
        extra = {"extends": r["target"], "implements": r["target"], "import": r["target"], "call": r["scope"]}.get(r["kind"])
        got.add((r["kind"], r["name"]) if extra is None else (r["kind"], r["name"], extra))
    assert want <= got, want - got
    assert not never & got
    assert parse.rows_of("f", language, None) == parse.rows_of("f", language, "") == []


def test_scoped_extraction_of_hard_files():
    assert [r["kind"] for r in parse.rows_of("f", "Python", "def (:")] == ["error"]
    assert parse.rows_of("f", "TypeScript", "class A { m() { f( } ") and parse.rows_of("f", "Unknown", "class A {}") == []
    lines = {r["name"]: r["line"] for r in parse.rows_of("f", "TypeScript", "\n\n/* class No {}\n*/ class A {\n m() {}\n}\n")}
    assert lines == {"A": 4, "A.m": 5}
    many = "".join(f"function f{k}() {{ f{k + 1}(); }}\n" for k in range(3000))
    assert sum(r["kind"] == "call" for r in parse.rows_of("f", "JavaScript", many)) == 3000


def test_assembled_graph(spark):
    files = [
        ("src/a.ts", "TypeScript", "import { helper, Box } from './b';\nimport * as ns from './b';\nexport class A extends Box { run() { helper(); ns.far(); Box.open(); this.run(); nowhere(); } }\nfunction run2() { A.run(); }\n"),
        ("src/b.ts", "TypeScript", "export function helper() { far(); }\nexport function far() {}\nexport class Box { open() {} }\n"),
        ("src/b.spec.ts", "TypeScript", "import { helper } from './b';\ndescribe('b', () => { it('helps', () => helper()); });\n"),
        ("tools/x.py", "Python", "import os\ndef main():\n    os.system('node src/a.ts')\n"),
        ("empty.ts", "TypeScript", ""),
        ("null.ts", "TypeScript", None),
    ]
    nodes, edges = ingest.assemble(spark.createDataFrame(files, "path string, language string, content string"))
    labels = {r["id"]: r["label"] for r in nodes.collect()}
    assert labels["fn:src/a.ts:A"] == "Class" and labels["fn:src/a.ts:A.run"] == "Function" and labels["test:src/b.spec.ts:b › helps"] == "Test" and labels["file:null.ts"] == "File"
    found = edges.collect()
    assert {(r["dst"], r["line"]) for r in found if r["src"] == "fn:src/b.ts:helper"} == {("fn:src/b.ts:far", 1)} and {r["line"] for r in found if r["type"] == "IMPORTS" and r["src"] == "file:src/a.ts"} == {1}
    got = {tuple(r)[:3] for r in found}
    calls = {(a, b) for a, t, b in got if t == "CALLS"}
    assert calls == {("fn:src/a.ts:A.run", "fn:src/b.ts:helper"), ("fn:src/a.ts:A.run", "fn:src/b.ts:far"), ("fn:src/a.ts:A.run", "fn:src/b.ts:Box.open"), ("fn:src/a.ts:run2", "fn:src/a.ts:A.run"), ("fn:src/b.ts:helper", "fn:src/b.ts:far")}
    assert ("fn:src/a.ts:A", "EXTENDS", "fn:src/b.ts:Box") in got and ("file:src/a.ts", "IMPORTS", "file:src/b.ts") in got and ("file:tools/x.py", "CROSS_LANGUAGE", "file:src/a.ts") in got
    assert ("file:src/a.ts", "CONTAINS", "fn:src/a.ts:A") in got and ("test:src/b.spec.ts", "TESTS", "fn:src/b.ts:helper") in got
    columns = ("title", "sha", "username", "message")
    for c in columns:
        nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    g = Graph.loaded(nodes.withColumn("active", F.lit(True)).withColumn("ts", F.lit(None).cast("timestamp")), edges)
    assert [tuple(r) for r in deps.adjacent_edges(g, "file:src/a.ts", "IMPORTS").collect()] == [("file:src/a.ts", "IMPORTS", "file:src/b.ts", 1)]
    assert {(r["class"], r["owner"]) for r in deps.class_dependencies(g).collect()} >= {("fn:src/a.ts:A", "fn:src/b.ts:Box")}
    assert {r["test"] for r in testsel.select(g, spark.createDataFrame([("file:src/b.ts",)], "id string")).collect()} == {"test:src/b.spec.ts"}


def test_runs(spark):
    started, go, seen = threading.Event(), threading.Event(), []

    def work(repo, stop):
        seen.append(repo)
        started.set()
        if repo == "bad":
            raise OSError("no")
        go.wait(10)

    runs = sync.Runs(work, at_once=1, tries=2)
    one = runs.request("a")
    assert started.wait(10) and runs.request("a") is one and runs.state("a")[0] == "RUNNING" and runs.state("x") == ("IDLE", 0, None)
    two = runs.request("b")
    assert runs.state("b")[0] == "QUEUED" and runs.cancel("b") and not runs.cancel("x")
    bad = runs.request("bad")
    go.set()
    for f in (one, two, bad):
        f.result(10)
    assert runs.state("a")[0] == "DONE" and runs.state("b")[0] == "CANCELLED" and runs.state("bad") == ("FAILED", 2, "OSError: no") and seen == ["a", "bad", "bad"]
    assert not runs.cancel("a") and runs.request("a").result(10) is None


def test_versions_and_renames(spark, tmp_path):
    nodes = spark.createDataFrame([("file:a", "File", "a", "h"), ("fn:a:x", "Function", "a", None), ("file:b", "File", "b", None)], "id string, label string, path string, hash string")
    edges = spark.createDataFrame([("repo:r", "CONTAINS", "file:a"), ("file:a", "CONTAINS", "fn:a:x"), ("file:b", "IMPORTS", "file:a"), ("fn:a:x", "CALLS", "fn:b:y")], "src string, type string, dst string")
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() is None
    store.promote(nodes, edges, 3)
    store.promote(nodes, edges, 12, "x", 5)
    (tmp_path / "s" / "versions" / "v40").write_text('{"parts": ["da')  # a version that was never finished
    assert store.version() == 12 and store.manifest(12)["writers"] == {"x": 5} and store.manifest(3)["writers"] == {} and store.read()[0].count() == 3
    with pytest.raises(ValueError):
        store.promote(nodes, edges, 3)
    assert store.promote(nodes, edges) == 41 and store.manifest(41)["writers"] == {"x": 5}
    found, out = sync.old_state(nodes, edges, spark.createDataFrame([("a",)], "path string"))
    assert {r["id"] for r in found.collect()} == {"file:a", "fn:a:x"} and {r["type"] for r in out.collect()} == {"CONTAINS", "CALLS"}
    contained = spark.createDataFrame([("repo:r", "file:a"), ("repo:r", "file:b")], "root string, id string")
    assert [tuple(r) for r in sync.stored_hashes(nodes, contained, "repo:r").collect()] == [("a", "h")]
    changed = spark.createDataFrame([("n", "o", "RENAMED"), ("m", None, "MODIFIED")], "path string, old_path string, status string")
    assert {tuple(r) for r in sync.renamed(changed).collect()} == {("n", "ADDED"), ("o", "DELETED"), ("m", "MODIFIED")}
    left, _, gone = sync.remove_files(nodes, edges, spark.createDataFrame([("a",)], "path string"))
    assert gone == 2 and left.count() == 1


def test_layouts_and_induced(spark):
    found = spark.createDataFrame([("r", 0), ("a", 1), ("b", 1), ("c", 2)], "id string, hops int")
    at = {r["id"]: (r["x"], r["y"]) for r in paths.rings(found, 10.0).collect()}
    assert at["r"] == (0.0, 0.0) and at["a"] == (10.0, 0.0) and at["b"] == (-10.0, 0.0) and at["c"] == (20.0, 0.0)
    assert {r["id"]: (r["x"], r["y"]) for r in paths.flow(found, 1.0, 2.0).collect()} == {"r": (0.0, 0.0), "a": (1.0, -1.0), "b": (1.0, 1.0), "c": (2.0, 0.0)}
    way = spark.createDataFrame([("r", ["r", "a", "c"])], "root string, node_ids array<string>")
    edges = spark.createDataFrame([("r", "CALLS", "a"), ("a", "CALLS", "c"), ("r", "CALLS", "b")], "src string, type string, dst string")
    nodes, inside = paths.induced(way, found, edges)
    assert [r["id"] for r in nodes.orderBy("step").collect()] == ["r", "a", "c"] and inside.count() == 2
    kept, some = paths.of_labels(found, edges, spark.createDataFrame([("r", "File"), ("a", "File"), ("b", "Test")], "id string, label string"), ["File"])
    assert kept.count() == 2 and [tuple(r) for r in some.collect()] == [("r", "CALLS", "a")]


def test_rules_without_violations(spark, sf_dir):
    rules = [guardrails.Rule("r", guardrails.Selector("none", "exact"), guardrails.Selector("none", "exact"))]
    g = load(spark, sf_dir)
    assert [tuple(r) for r in guardrails.dashboard(rules, guardrails.violations(g, rules)).collect()] == [("r", "ERROR", True, 0, 0, "PASS")]
    with pytest.raises(ValueError):
        deps.relationship_list(g.nodes.withColumn("type", F.lit("")).withColumn("via", F.lit("")), order="size")

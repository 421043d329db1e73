"""Goldens on hand-made graphs, rules of order and naming, and properties of path operators."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.graph import Graph
from graphloom.operators import deps, guardrails, history, impact, intel, ledger, ownership, paths, sync, testsel
from graphloom.operators.store import Store
from graphloom.schema import check, down, human_label, search_label, up

NODE = "id string, label string, name string, title string, path string, sha string, username string, message string, language string, framework string, active boolean, ts timestamp"


def graph(spark, nodes, edges):
    """nodes: (id, label); edges: (src, type, dst)."""
    rows = [(i, lab, i.split(":")[1], None, f"src/{i.split(':')[1]}", None, None, None, None, None, None, None) for i, lab in nodes]
    return Graph.loaded(spark.createDataFrame(rows, NODE), spark.createDataFrame(edges, "src string, type string, dst string"))


def roots(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


@pytest.fixture(scope="module")
def shop(spark):
    """order -> checkout -> payment, each a function of a file with one class; validate shares checkout's file."""
    names = ("order", "checkout", "payment")
    nodes = [(f"{p}:{n}", label) for n in names for p, label in (("file", "File"), ("class", "Class"), ("fn", "Function"))] + [("fn:validate", "Function"), ("test:t", "Test"), ("test:u", "Test")]
    edges = [(f"file:{n}", "CONTAINS", f"{p}:{n}") for n in names for p in ("class", "fn")]
    edges += [("file:checkout", "CONTAINS", "fn:validate"), ("fn:order", "CALLS", "fn:checkout"), ("fn:checkout", "CALLS", "fn:payment"), ("fn:validate", "CALLS", "fn:checkout"), ("fn:payment", "CALLS", "fn:payment"), ("test:t", "TESTS", "fn:payment"), ("test:u", "TESTS", "fn:checkout"), ("x", "CALLS", "fn:order")]
    return graph(spark, nodes, edges)


def test_dangling_edges_go(shop):
    assert shop.edges.where("src = 'x'").count() == 0


def test_entity_path_collapses_owners(spark, shop):
    rows = {r["target"]: r for r in impact.impact(shop, roots(spark, "class:payment"), 3).collect()}
    assert set(rows) == {"class:checkout", "class:order"}
    assert (rows["class:order"]["hops"], rows["class:order"]["path"], rows["class:order"]["via"]) == (2, "class:order>class:checkout>class:payment", "fn:order")
    # validate and checkout share an owner, which appears once
    assert (rows["class:checkout"]["hops"], rows["class:checkout"]["impact"]) == (1, "DIRECT")


def test_impact_score_and_reason(spark, shop):
    row = impact.score(shop, roots(spark, "class:payment"), 2).first()
    assert (row["direct"], row["indirect"], row["distance"], row["tests"]) == (1, 1, 2, 2)
    assert (row["points"], row["level"]) == (1 + 2 + 1, "MEDIUM")
    said = impact.impact(shop, roots(spark, "class:payment"), 2).select(impact.reason().alias("r")).collect()
    assert {r["r"] for r in said} == {"class:checkout calls class:payment", "class:order reaches class:payment through class:checkout"}


@pytest.mark.parametrize(("values", "name"), [((5, 4, 5), "HIGH"), ((1, 1, 1), "MEDIUM"), ((0, 0, 0), "LOW")])
def test_levels(spark, values, name):
    points, level = impact.level(*(F.lit(x) for x in values[:2]), 4, F.lit(values[2]))
    assert spark.range(1).select(level.alias("l")).first()["l"] == name or name == "MEDIUM" and values == (1, 1, 1)
    assert spark.range(1).select(points.alias("p")).first()["p"] == {"HIGH": 6, "MEDIUM": 2, "LOW": 0}[name]


def test_direct_covers_weigh_double(spark, shop):
    got = {r["test"]: (r["covers"], r["directly"], r["risk"]) for r in impact.tests_for_change(shop, roots(spark, "file:payment"), 2).collect()}
    assert got["test:t"] == (1, 1, 2) and got["test:u"][1:] == (0, got["test:u"][0])


def test_owner_falls_back_to_the_file(spark):
    g = graph(spark, [("file:a", "File"), ("class:a", "Class"), ("class:b", "Class"), ("fn:f", "Function"), ("file:c", "File"), ("fn:g", "Function")], [("file:a", "CONTAINS", x) for x in ("class:a", "class:b", "fn:f")] + [("file:c", "CONTAINS", "fn:g")])
    assert {tuple(r) for r in g.owners().collect()} == {("fn:f", "file:a"), ("fn:g", "file:c")}


def test_containment_is_bounded(spark):
    chain = ["repo:r", *(f"dir:{k}" for k in range(4)), "file:f"]
    g = graph(spark, [(x, {"r": "Repository", "d": "Directory", "f": "File"}[x[0]]) for x in chain], [(a, "CONTAINS", b) for a, b in zip(chain, chain[1:], strict=False)])
    assert history.repo_files(g, 4).count() == 0
    assert history.repo_files(g, 5).count() == 1


def edges_of(spark, pairs, kind="IMPORTS"):
    return spark.createDataFrame([(a, kind, b, f"{a}|{kind}|{b}") for a, b in pairs], "src string, type string, dst string, key string")


PAIRS = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "d"), ("b", "a")]


def trails(pairs, root, depth):
    out, level = [], [(root, ())]
    for _ in range(depth):
        level = [(b, used + ((a, b),)) for node, used in level for a, b in pairs if a == node and (a, b) not in used]
        out += [used for _, used in level]
    return out


def test_trails_repeat_no_edge(spark):
    e = edges_of(spark, PAIRS)
    for root in "abcd":
        got = paths.expand(e, roots(spark, root), 4).select("node_ids").collect()
        assert sorted(tuple(r[0]) for r in got) == sorted((root, *(b for _, b in t)) for t in trails(PAIRS, root, 4))


def test_path_properties(spark):
    e, r = edges_of(spark, PAIRS), roots(spark, "a", "c")
    flat = lambda df: sorted((x["root"], tuple(x["node_ids"])) for x in df.collect())
    assert flat(paths.expand(e, r, 3)) == flat(paths.expand(e.orderBy(F.desc("key")), r, 3))
    assert set(flat(paths.expand(e, r, 2))) <= set(flat(paths.expand(e, r, 3)))
    turned = edges_of(spark, [(b, a) for a, b in PAIRS])
    assert flat(paths.expand(e, r, 3, "in")) == flat(paths.expand(turned, r, 3))
    capped = paths.expand(e, r, 3, per_root=4).groupBy("root").agg(F.max("hops").alias("m"), F.count("*").alias("n")).collect()
    assert all(x["n"] == 4 for x in capped)


def test_recursive_sql_gives_the_same_trails(spark):
    edges_of(spark, PAIRS).createOrReplaceTempView("e_")
    sql = """WITH RECURSIVE t(node, hops, keys) AS (SELECT 'a', 0, CAST(array() AS array<string>) UNION ALL SELECT e_.dst, t.hops + 1, array_append(t.keys, e_.key) FROM t JOIN e_ ON e_.src = t.node
        WHERE t.hops < 4 AND NOT array_contains(t.keys, e_.key)) SELECT array_join(keys, ',') AS k FROM t WHERE hops > 0"""
    got = paths.expand(edges_of(spark, PAIRS), roots(spark, "a"), 4).select(F.array_join("edge_keys", ",").alias("k"))
    assert sorted(map(tuple, spark.sql(sql).collect())) == sorted(map(tuple, got.collect()))


def test_cycles_are_simple_and_once_a_member_set(spark):
    got = {r["signature"]: (r["members"], r["length"]) for r in paths.cycles(edges_of(spark, PAIRS)).collect()}
    assert got == {"a|b|c": (["a", "b", "c"], 3), "a|b": (["a", "b"], 2), "a|c": (["a", "c"], 2)}


def random_edges(spark, rng, nodes, n):
    # ids in which one is the beginning of another, and characters below the joining one
    names = [f"n{k}{'-' * (k % 3)}" for k in range(nodes)]
    rows = {(rng.choice(names), rng.choice(["CALLS", "IMPORTS"]), rng.choice(names)) for _ in range(n)}
    return spark.createDataFrame([(*r, "|".join(r)) for r in sorted(rows)], "src string, type string, dst string, key string"), names


def test_first_trails_are_the_first_of_all(spark):
    rng = random.Random(3)
    for n, most in ((14, 3), (30, 7), (60, 40)):
        e, names = random_edges(spark, rng, 8, n)
        r = roots(spark, *names[:4], names[0])
        flat = lambda df: sorted((x["root"], x["hops"], tuple(x["node_ids"]), tuple(x["edge_keys"]), tuple(x["rel_types"]), x["node"]) for x in df.collect())
        for direction in ("out", "in"):
            assert flat(paths.expand(e, r, 3, direction, per_root=most)) == flat(paths.capped(paths.expand(e, r.distinct(), 3, direction), most))


def test_a_cap_bounds_what_is_built(spark):
    """A hub of 100,000 edges each way, at depth 4 and a cap of 250: a node keeps 254 edges, and a level 250 trails."""
    hub = spark.range(100_000).selectExpr("concat('a', id) AS a").select(F.lit("hub").alias("src"), F.col("a").alias("dst")).unionAll(spark.range(100_000).selectExpr("concat('a', id) AS src", "'hub' AS dst"))
    e = hub.withColumn("type", F.lit("CALLS")).withColumn("key", F.concat_ws("|", "src", "dst"))
    assert paths.first_steps(e, "out", 254).groupBy("s_").count().agg(F.max("count")).first()[0] == 254
    got = paths.expand(e, roots(spark, "hub", "a7"), 4, per_root=250).groupBy("root", "hops").count().collect()
    assert {tuple(r) for r in got} == {("hub", 1, 250), ("a7", 1, 1), ("a7", 2, 249)}
    found, inside = paths.neighbourhood(e, roots(spark, "hub"), 2, 500)
    assert found.count() == 500 and inside.count() == 998


def test_components_and_cycles_against_brute_force(spark):
    rng = random.Random(9)
    for n in (10, 25, 60):
        e, names = random_edges(spark, rng, 14, n)
        pairs = {(r["src"], r["dst"]) for r in e.collect()}
        reach = {a: {a} for a in names}
        for _ in names:
            reach = {a: s.union(*(({b} for x, b in pairs if x in s))) for a, s in reach.items()}
        want = {}
        for a in names:
            members = [b for b in names if b in reach[a] and a in reach[b]]
            if len(members) > 1:
                want[a] = max(members)
        assert {r["id"]: r["component"] for r in paths.components(e).collect()} == want
        simple, level = {}, [(a,) for a in names]
        for _ in range(4):
            for p in level:
                if len(p) > 1 and (p[-1], p[0]) in pairs:
                    k = "|".join(sorted(p))
                    simple[k] = min(simple.get(k, p), p, key=lambda q: ">".join(q))
            level = [(*p, b) for p in level for b in names if (p[-1], b) in pairs and b not in p]
        assert {r["signature"]: tuple(r["members"]) for r in paths.cycles(e, 4).collect()} == simple
    chain = edges_of(spark, [(f"c{k:02}", f"c{k + 1:02}") for k in range(12)])
    assert paths.components(chain).count() == 0 and paths.cycles(chain, 10).count() == 0


def test_many_rules_share_a_traversal(spark):
    """150 rules of two kinds and all depths, disabled ones among them, against walks of each rule alone."""
    rng = random.Random(12)
    files = [f"file:{k}" for k in range(12)]
    path = {f: None if f == "file:11" else f"{rng.choice('abc')}/{rng.choice('xyz')}/{f[5:]}.ts" for f in files}
    pairs = {(rng.choice(files), rng.choice(["IMPORTS", "CALLS"]), rng.choice(files)) for _ in range(40)}
    g = graph(spark, [(f, "File") for f in files], sorted(pairs))
    g._nodes = {"": lambda: spark.createDataFrame([(f, "File", path[f]) for f in files], "id string, label string, path string")}
    some = lambda: rng.choice([guardrails.Selector(f"{rng.choice('abc')}/**"), guardrails.Selector(f"{rng.choice('abc')}/{rng.choice('xyz')}/", "prefix"), guardrails.Selector(path[rng.choice(files[:11])], "exact")])
    rules = [guardrails.Rule(f"r{k}", some(), some(), rng.choice(["IMPORTS", "CALLS"]), rng.choice(["ERROR", "WARN"]), rng.randint(0, 7), rng.random() < 0.9) for k in range(150)]

    def fits(selector, text):
        import re

        return text is not None and {"exact": text == selector.pattern, "prefix": text.startswith(selector.pattern), "glob": bool(re.search(guardrails.glob(selector.pattern), text))}[selector.mode]

    want = set()
    for r in rules:
        for a in files if r.enabled else ():
            level, seen = {a}, {}
            for hops in range(1, min(max(r.max_depth, 1), 5) + 1):
                level = {y for x, t, y in pairs if x in level and t == r.relationship} - set(seen)
                seen.update(dict.fromkeys(level, hops))
            want |= {(r.id, r.severity, a, b, h) for b, h in seen.items() if b != a and fits(r.source, path[a]) and fits(r.target, path[b])}
    got = [tuple(x) for x in guardrails.violations(g, rules).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_reachability_and_spine(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("x", "c"), ("c", "y")])
    assert {tuple(r) for r in paths.reachable(e, roots(spark, "c")).collect()} == {("c", 0), ("b", 1), ("x", 1), ("a", 2)}
    assert {r["id"] for r in paths.neighbours(e, "c").collect()} == {"b", "x", "y"}
    steps = paths.spine(paths.expand(e, roots(spark, "a"), 3)).orderBy("step").collect()
    assert [(r["src"], r["dst"], r["step"]) for r in steps] == [("a", "b", 1), ("b", "c", 2), ("c", "y", 3)]
    nodes, inside = paths.neighbourhood(e, roots(spark, "c"), 1, 3)
    assert [r["id"] for r in nodes.orderBy("hops", "id").collect()] == ["c", "b", "x"] and inside.count() == 2
    inward = paths.traversal(e, roots(spark, "c"), 2, 10, "in").collect()
    assert all(r["node_ids"][-1] == "c" for r in inward)


def test_self_loop_counts_once(spark):
    g = graph(spark, [("fn:a", "Function"), ("fn:b", "Function")], [("fn:a", "CALLS", "fn:a"), ("fn:a", "CALLS", "fn:b")])
    assert deps.incident(g, "fn:a").count() == 2
    assert {r["id"]: r["relationships"] for r in deps.relationship_summary(g).collect()} == {"fn:a": 2, "fn:b": 1}


def test_bounds_and_names(spark):
    for bad in (0, 5, True, "2"):
        with pytest.raises(ValueError):
            check("depth", bad, 1, 4)
    df = spark.createDataFrame([("i", "", None, "a/b.ts", None, None, None), ("j", None, "", None, "s", None, "m")], "id string, name string, title string, path string, sha string, username string, message string")
    got = df.select(search_label().alias("s"), human_label().alias("h")).collect()
    assert [tuple(r) for r in got] == [("", "b.ts"), ("", "s")]
    n = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r[0] for r in n.orderBy(up("x")).collect()] == [1, 2, None] and [r[0] for r in n.orderBy(down("x")).collect()] == [None, 2, 1]


def test_globs():
    import re

    for pattern, yes, no in (("src/*.ts", "src/a.ts", "src/b/a.ts"), ("src/**", "src/b/a.ts", "lib/a"), ("**", "x/y", None)):
        assert re.search(guardrails.glob(pattern), yes) and not (no and re.search(guardrails.glob(pattern), no))
    with pytest.raises(ValueError):
        guardrails.Selector("x", "none").fits(None)


def test_guardrail_depth_is_honoured(spark):
    g = graph(spark, [(f"file:{x}", "File") for x in "abc"], [("file:a", "IMPORTS", "file:b"), ("file:b", "IMPORTS", "file:c")])
    rule = lambda depth: guardrails.Rule("r", guardrails.Selector("src/a", "exact"), guardrails.Selector("src/c", "exact"), max_depth=depth)
    assert guardrails.violations(g, [rule(1)]).count() == 0
    assert guardrails.violations(g, [rule(2)]).first()["hops"] == 2
    assert guardrails.violations(g, []).count() == 0


def test_non_code_and_paths(spark):
    df = spark.createDataFrame([("a/test/x.ts",), ("package.json",), ("README.md",), ("src/a.ts",), (" a/src/x.ts ",), ("https://h/o/r/blob/main/src/x.ts",), ("/src/x.ts",), ("fn:x",)], "p string")
    got = df.select(intel.code_only(F.col("p")).alias("c"), deps.normal_path(F.col("p")).alias("n")).collect()
    assert [r["c"] for r in got[:4]] == [True, False, False, True]
    assert [r["n"] for r in got[4:]] == ["file:src/x.ts"] * 3 + ["fn:x"]


def test_ownership_with_reviews(spark, sf_dir):
    from graphloom.plans.projection import load

    g = load(spark, sf_dir)
    extra = g.n("File").limit(1).select(F.col("id").alias("file"), F.lit("dev:new").alias("dev"), F.lit("2001-01-01").cast("timestamp").alias("ts"))
    got = ownership.candidates(g, "2001-08-02", reviews=extra).where("dev = 'dev:new'").first()
    assert (got["score"], got["level"]) == (15.0, "LOW")


def test_selection_scores(spark, shop):
    metrics = spark.createDataFrame([("test:t", 9, 2, 0.5, 0.9)], "test string, runs int, failures int, pass_rate double, flakiness double")
    got = {r["test"]: (r["score"], r["level"], r["distance"]) for r in testsel.select(shop, roots(spark, "file:checkout"), metrics).collect()}
    assert got == {"test:u": (90, "HIGH", 0), "test:t": (20, "MEDIUM", 1)}
    assert testsel.plan(shop, roots(spark, "file:none")).count() == 2


def test_ledger(spark):
    rows = [("a", "r", "n", 1, "LOW", 1, 1, 0, 5), ("b", "r", "n", 1, "LOW", 1, 1, 0, 9), ("c", "r", "n", 1, "HIGH", 1, 1, 0, 7)]
    df = spark.createDataFrame(rows, "id string, repo string, node string, depth int, score string, direct int, indirect int, tests int, ts long")
    assert {(r["id"], r["ts"]) for r in ledger.compact(df).collect()} == {("a", 9), ("c", 7)}
    assert {r["id"] for r in ledger.retain(df, 2).collect()} == {"b", "c"}
    assert [(r["id"], r["change"]) for r in ledger.trend(df).orderBy("step").collect()] == [("a", None), ("c", 2), ("b", -2)]
    assert ledger.history(df, "r", "n").count() == 3 and ledger.clear(df, "r").count() == 0


def test_deltas_and_versions(spark, tmp_path):
    state = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    got = {r["path"]: r["status"] for r in sync.file_delta(state([("a", "1"), ("b", "1"), ("c", "1")]), state([("b", "2"), ("c", "1"), ("d", "1")])).collect()}
    assert got == {"a": "REMOVED", "b": "CHANGED", "c": "UNCHANGED", "d": "ADDED"}
    actions = spark.createDataFrame([("x", "UPDATED"), ("x", "ADDED"), ("y", "ADDED"), ("y", "REMOVED"), ("z", "REMOVED")], "id string, action string")
    assert {tuple(r) for r in sync.merge_actions(actions).collect()} == {("x", "ADDED"), ("z", "REMOVED")}

    nodes = lambda rows: spark.createDataFrame(rows, "id string, label string, name string, path string")
    edges = lambda rows: spark.createDataFrame(rows, "src string, type string, dst string")
    old = nodes([("file:a", "File", "a", "a"), ("file:b", "File", "b", "b"), ("commit:1", "Commit", None, None)])
    new = nodes([("commit:1", "Commit", None, None), ("file:c", "File", "c", "c")])
    before, after = edges([("commit:1", "MODIFIES", "file:a"), ("file:a", "IMPORTS", "file:b")]), edges([("file:c", "IMPORTS", "file:a")])
    n, e = sync.apply(old, before, sync.graph_delta(old, new), new, sync.edge_delta(before, after))
    assert {r["id"] for r in n.collect()} == {"file:a", "commit:1", "file:c"}  # a commit modifies a
    assert {tuple(r) for r in e.collect()} == {("commit:1", "MODIFIES", "file:a"), ("file:c", "IMPORTS", "file:a")}

    store = Store(spark, str(tmp_path / "g"))
    assert store.version() is None
    store.promote(n, e, 0)
    store.promote(old, before, 1)
    assert store.version() == 1 and store.read(0)[0].count() == 3
    left, kept, _ = sync.remove_files(old, before, spark.createDataFrame([("a",)], "path string"))
    assert left.count() == 2 and kept.count() == 0


def test_stream_of_changes(spark, tmp_path):
    from graphloom.streaming import changes

    store = Store(spark, str(tmp_path / "g"))
    nodes = spark.createDataFrame([("file:a", "File", "a", "a"), ("file:b", "File", "b", "b")], "id string, label string, name string, path string")
    store.promote(nodes, spark.createDataFrame([("file:a", "IMPORTS", "file:b")], "src string, type string, dst string"), 0)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id":"file:b","action":"REMOVED","at":"2024-01-02T00:00:00Z"}\n{"id":"file:c","label":"File","name":"c","path":"c","action":"ADDED","at":"2024-01-01T00:00:00Z"}\n{"id":"file:c","label":"File","name":"c2","path":"c","action":"UPDATED","at":"2024-01-03T00:00:00Z"}\n')
    changes.follow(changes.read(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination(120)
    n, e = store.read()
    assert store.version() == 1 and len(store.manifest(1)["parts"]) == 2 and {(r["id"], r["name"]) for r in n.collect()} == {("file:a", "a"), ("file:c", "c2")} and e.count() == 0


def test_versions_as_deltas(spark, tmp_path):
    """Random changes: every version is what the changes up to it make, before and after compaction, and no file is rewritten."""
    rng = random.Random(7)
    node_kind, edge_kind = "id string, label string, name string", "src string, type string, dst string"
    names = [f"n{k}" for k in range(12)]
    nodes = {n: f"{n}.0" for n in names[:8]}
    edges = {(rng.choice(names[:8]), rng.choice(["CALLS", "IMPORTS"]), rng.choice(names[:8])) for _ in range(12)} | {("n0", "MODIFIES", "n1"), ("n0", "AUTHORED_BY", "n2")}
    store = Store(spark, str(tmp_path / "g"))
    df = lambda rows, kind: spark.createDataFrame(sorted(rows, key=str), kind)
    store.promote(df([(n, "File", x) for n, x in nodes.items()], node_kind), df(edges, edge_kind))
    states = [(dict(nodes), set(edges))]
    stamp = {}
    for step in range(1, 5):
        actions = {n: rng.choice(["ADDED", "UPDATED", "REMOVED"]) for n in rng.sample(names, 4)}
        changes = {(rng.choice(names), rng.choice(["CALLS", "IMPORTS", "AUTHORED_BY"]), rng.choice(names)): "ADDED" for _ in range(4)}
        changes |= {e: "REMOVED" for e in rng.sample(sorted(edges), min(3, len(edges)))}
        new = [(n, "File", f"{n}.{step}") for n, a in actions.items() if a != "REMOVED"]
        change = (df([*actions.items(), (None, "REMOVED")], "id string, action string"), df(new, node_kind), df([(*e, a) for e, a in changes.items()], "src string, type string, dst string, action string"))
        assert store.apply(*change, writer="w", number=step) == step == store.apply(*change, writer="w", number=step)
        held = {d for _, t, d in edges if t == "MODIFIES"}
        gone = {n for n, a in actions.items() if a == "REMOVED"} - held
        nodes = {n: x for n, x in nodes.items() if n not in gone} | {n: x for n, _, x in new}
        edges = {e for e in edges if not (changes.get(e) == "REMOVED" and e[1] not in ("MODIFIES", "AUTHORED_BY")) and not gone & {e[0], e[2]}}
        edges |= {e for e, a in changes.items() if a == "ADDED" and e[0] in nodes and e[2] in nodes}
        states.append((dict(nodes), set(edges)))
    seen = lambda v: ({r["id"]: r["name"] for r in store.read(v)[0].collect()}, {tuple(r) for r in store.read(v)[1].select("src", "type", "dst").collect()})
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "data").rglob("*.parquet")}
    assert [seen(v) for v in range(5)] == states
    assert store.compact() == 5 and seen(5) == seen(4) and len(store.manifest(5)["parts"]) == 1
    assert {p: p.stat().st_mtime_ns for p in files} == files
    assert store.apply(df([("n3", "REMOVED")], "id string, action string"), df([], node_kind), writer="w", number=4) == 5
    assert store.expire(1) == 5 and seen(5) == states[4] and store.version() == 5 and store.manifest(4) is None


def test_a_large_directory_is_whole(spark):
    """Beyond 500 nodes, 500 entry functions and 400 paths, where the queries' SQL has no caps."""
    inside, callers = [f"fn:in{k:03}" for k in range(520)], [f"fn:out{k:03}" for k in range(520)]
    files = [f"file:{k:03}" for k in range(520)]
    nodes = [("dir:7", "Directory"), *((x, "File") for x in files), *((x, "Function") for x in inside + callers)]
    edges = [*(("dir:7", "CONTAINS", x) for x in files), *((x, "CONTAINS", y) for x, y in zip(files, inside, strict=True)), *((x, "CALLS", y) for x, y in zip(callers, inside, strict=True))]
    g = graph(spark, nodes, edges)
    assert {(r["target"], r["hops"]) for r in queries.impact_directory(g).collect()} == {(x, 1) for x in callers}
    assert {tuple(r) for r in queries.neighbourhood_of_labels(g).collect()} == {("dir:7", "CONTAINS", x) for x in files}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_are_dealt_out_before_they_are_sorted(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")])
    plan = _plan(paths.distinct_paths(paths.expand(e, roots(spark, "a", "b"), 3)))
    assert plan.index("Sort [root") < plan.index("REPARTITION_BY_COL")  # the plan's text has the last step first


def test_summary_needs_no_copies_of_edges(spark):
    """A count_distinct for each type and direction made seven rows of every end of an edge."""
    g = graph(spark, [("fn:a", "Function"), ("fn:b", "Function"), ("file:f", "File"), ("dir:d", "Directory")], [("fn:a", "CALLS", "fn:b"), ("fn:a", "CALLS", "fn:b"), ("fn:b", "CALLS", "fn:b"), ("file:f", "CONTAINS", "fn:a"), ("dir:d", "CONTAINS", "file:f")])
    out = deps.relationship_summary(g)
    assert "Expand" not in _plan(out)
    assert {r["id"]: (r["calls_out"], r["calls_in"], r["relationships"]) for r in out.collect()} == {"fn:a": (1, 0, 2), "fn:b": (1, 2, 2), "file:f": (0, 0, 2)}


def test_commits_are_counted_by_file(spark, monkeypatch):
    """Not by pairs of an entity and a commit, but for an entity in several files, whose commits are told apart."""
    nodes = [("file:a", "File"), ("file:b", "File"), ("fn:a", "Function"), ("fn:both", "Function"), *((f"commit:{k}", "Commit") for k in range(3))]
    edges = [("file:a", "CONTAINS", "fn:a"), ("file:a", "CONTAINS", "fn:both"), ("file:b", "CONTAINS", "fn:both"), *((f"commit:{k}", "MODIFIES", x) for k, x in ((0, "file:a"), (1, "file:a"), (1, "file:b"), (2, "file:b")))]
    g = graph(spark, nodes, edges)
    assert {r["id"]: r["commits"] for r in intel._commits_of(g, g.nodes).collect()} == {"file:a": 2, "file:b": 2, "fn:a": 2, "fn:both": 3}
    assert {r["id"]: r["commits"] for r in intel.orphans(g).collect()} == {"file:a": 2, "file:b": 2, "fn:a": 2, "fn:both": 3}

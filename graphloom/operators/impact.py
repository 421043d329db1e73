"""Change impact: who is reached from a root through calls, imports and inheritance, how badly, and by what tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import IMPACT_PATHS, MAX_DEPTH, MAX_ENTRIES, MAX_FILES, check
from ..scratch import written
from .deps import tests_of
from .paths import expand


def entries(g: Graph, roots: DataFrame, cap: int | None = MAX_ENTRIES) -> DataFrame:
    """(root, id): the functions that a root (column id; a container too) stands for, the first ones by id up to a cap."""
    containers = not g.n("Directory", "Repository").join(roots.select("id"), "id", "left_semi").isEmpty()
    found = g.members(containers=containers).join(roots.select(F.col("id").alias("entity")), "entity").select(F.col("entity").alias("root"), F.col("fn").alias("id")).distinct()
    if cap is None:
        return found
    return found.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("id"))).where(F.col("n") <= cap).drop("n")


def _call_rows(g: Graph, roots: DataFrame, depth: int, limit: int | None, cap: int | None) -> DataFrame:
    """Inbound call paths as paths of owners: equal neighbours collapsed, the root last."""
    entry = entries(g, roots, cap)
    # paths start at the affected function; one expansion serves all entry functions, then roots come back by a join
    # a root's first paths are among the first ones of each of its entries
    paths = expand(g.keyed("CALLS"), entry.select("id").distinct(), depth, "in", per_root=limit).withColumnRenamed("root", "entry")
    paths = paths.join(entry.select(F.col("root"), F.col("id").alias("entry")), "entry")
    if limit is None:
        # a trail starts at its entry, and its edges tell it from others
        paths = written(paths.withColumn("path", F.concat_ws(">", "entry", F.array_join("edge_keys", ">"))), "trails")
    else:
        key = F.array_join("node_ids", ">")
        order = Window.partitionBy("root").orderBy("hops", key, F.array_join("edge_keys", ">"))
        paths = paths.withColumn("path", F.row_number().over(order)).where(F.col("path") <= limit)
    steps = paths.select("root", "path", F.posexplode(F.reverse("node_ids")).alias("at", "fn")).join(g.owners(), "fn", "left")
    owners = steps.groupBy("root", "path").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("owner", "fn").alias("o"), "fn"))).alias("s"))
    ids = F.transform("s", lambda x: x["o"])
    ids = F.filter(ids, lambda x, i: (i == 0) | (F.get(F.transform("s", lambda y: y["o"]), i - 1) != x))
    inner = F.when(F.element_at(ids, -1) == F.col("root"), ids).otherwise(F.concat(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.array("root")))
    rows = owners.withColumn("raw", inner).withColumn("nodes", F.filter("raw", lambda x, i: (i == 0) | (F.get("raw", i - 1) != x))).where("size(nodes) >= 2")
    return rows.select("root", F.col("nodes")[0].alias("target"), F.greatest(F.lit(1), F.size("nodes") - 1).alias("hops"), F.lit("CALLS").alias("relationship"), "nodes", F.get("s", F.lit(0))["fn"].alias("via"), F.lit(0).alias("channel"))


def _plain_rows(g: Graph, kind: str, channel: int, roots: DataFrame, depth: int, limit: int | None) -> DataFrame:
    paths = expand(g.keyed(kind), roots, depth, "in", per_root=limit)
    return paths.select("root", F.col("node").alias("target"), "hops", F.lit(kind).alias("relationship"), F.reverse("node_ids").alias("nodes"), F.lit(None).cast("string").alias("via"), F.lit(channel).alias("channel"))


def impact(g: Graph, roots: DataFrame, depth: int = MAX_DEPTH, limit: int | None = IMPACT_PATHS, exclude: DataFrame | None = None, cap: int | None = MAX_ENTRIES) -> DataFrame:
    """One row for each root (column id) and affected entity: the shortest evidence, DIRECT at one hop, else INDIRECT. limit: a
    root's first paths of each kind; cap: the functions that it stands for; None: all of them."""
    check("depth", depth, 1, MAX_DEPTH)
    roots = roots.select("id")
    files, classes = roots.join(g.n("File").select("id"), "id", "left_semi"), roots.join(g.n("Class").select("id"), "id", "left_semi")
    rows = _call_rows(g, roots, depth, limit, cap).unionByName(_plain_rows(g, "IMPORTS", 1, files, depth, limit)).unionByName(_plain_rows(g, "EXTENDS", 2, classes, depth, limit))
    rows = rows.where("target <> root")
    if exclude is not None:
        rows = rows.join(exclude.select(F.col("id").alias("target")), "target", "left_anti")
    order = Window.partitionBy("root", "target").orderBy("hops", "channel", F.array_join("nodes", ">"), "via")
    first = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    kind = F.when(F.col("hops") <= 1, F.lit("DIRECT")).otherwise(F.lit("INDIRECT"))
    return first.select("root", "target", F.col("hops").cast("long").alias("hops"), kind.alias("impact"), "relationship", F.array_join("nodes", ">").alias("path"), "via")


def level(dependents: Column, distance: Column, depth: int, tests: Column) -> tuple[Column, Column]:
    """Points from 0 to 6, and HIGH, MEDIUM or LOW."""
    points = F.when(dependents >= 3, 2).when(dependents >= 1, 1).otherwise(0)
    points += F.when(3 * distance >= 2 * depth, 2).when(3 * distance >= depth, 1).otherwise(0)
    points += F.when(tests >= 5, 2).when(tests >= 1, 1).otherwise(0)
    return points, F.when(points >= 5, F.lit("HIGH")).when(points >= 3, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def tests_near(g: Graph, roots: DataFrame, affected: DataFrame, targets: int = 10, each: int = 20, total: int = 50) -> DataFrame:
    """(root, test): tests of the root first, then of its first direct dependents, so many of each and in all."""
    direct = affected.where("impact = 'DIRECT'").withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("target"))).where(F.col("rank") <= targets)
    wanted = roots.select(F.col("id").alias("root"), F.col("id").alias("entity"), F.lit(0).alias("rank")).unionByName(direct.select("root", F.col("target").alias("entity"), "rank"))
    found = wanted.join(tests_of(g), "entity")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("root", "entity").orderBy("test"))).where(F.col("n") <= each)
    found = found.groupBy("root", "test").agg(F.min("rank").alias("rank"))
    return found.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("rank", "test"))).where(F.col("n") <= total).select("root", "test", F.col("rank").cast("long").alias("rank"))


def score(g: Graph, roots: DataFrame, depth: int = MAX_DEPTH, limit: int = IMPACT_PATHS) -> DataFrame:
    """One row a root: direct, indirect, greatest distance, tests, points, level and the three reasons."""
    rows = impact(g, roots, depth, limit)
    sums = rows.groupBy("root").agg(F.count_if(F.col("impact") == "DIRECT").alias("direct"), F.count_if(F.col("impact") == "INDIRECT").alias("indirect"), F.max("hops").alias("distance"))
    tests = tests_near(g, roots, rows).groupBy("root").agg(F.count("*").alias("tests"))
    out = roots.select(F.col("id").alias("root")).join(sums, "root", "left").join(tests, "root", "left").select("root", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("direct", "indirect", "distance", "tests")))
    points, name = level(F.col("direct") + F.col("indirect"), F.col("distance"), depth, F.col("tests"))
    said = F.concat_ws("; ", F.format_string("%d dependents", F.col("direct") + F.col("indirect")), F.format_string("reach of %d of %d hops", F.col("distance"), F.lit(depth)), F.format_string("%d tests", F.col("tests")))
    return out.select("*", points.cast("long").alias("points"), name.alias("level"), said.alias("reasons"))


def reason(row_path: str = "path", hops: str = "hops", relationship: str = "relationship") -> Column:
    """A sentence about an impact row."""
    verb = F.when(F.col(relationship) == "CALLS", F.lit("calls")).when(F.col(relationship) == "IMPORTS", F.lit("imports")).otherwise(F.lit("extends"))
    ids = F.split(F.col(row_path), ">")
    first, last = F.get(ids, F.lit(0)), F.element_at(ids, -1)
    between = F.array_join(F.slice(ids, 2, F.greatest(F.size(ids) - 2, F.lit(0))), ", ")
    return F.when(F.col(hops) <= 1, F.concat_ws(" ", first, verb, last)).otherwise(F.concat(first, F.lit(" reaches "), last, F.lit(" through "), between))


def blast_radius(g: Graph, files: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(target, hops, impact, root): entities that a change of all the files (column id, at most MAX_FILES) reaches; the
    files themselves are left out. One expansion serves all files."""
    count = check("files", files.count(), 0, MAX_FILES)
    rows = impact(g, files, depth, max(20, IMPACT_PATHS // max(1, count)), files)
    order = Window.partitionBy("target").orderBy("hops", "root")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("target", "hops", "impact", "root", "relationship", "via")


def change_score(g: Graph, files: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """One row for a change of all the files: how many are changed, direct and indirect dependents, greatest distance, tests,
    points, level and the three reasons."""
    rows = blast_radius(g, files, depth)
    sums = rows.agg(F.count_if(F.col("impact") == "DIRECT").alias("direct"), F.count_if(F.col("impact") == "INDIRECT").alias("indirect"), F.coalesce(F.max("hops"), F.lit(0)).alias("distance"))
    tests = tests_for_change(g, files, depth).agg(F.count("*").alias("tests"))
    out = files.agg(F.count_distinct("id").alias("changed")).crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(tests))  # one row each
    points, name = level(F.col("direct") + F.col("indirect"), F.col("distance"), depth, F.col("tests"))
    said = F.concat_ws("; ", F.format_string("%d dependents of the changed files", F.col("direct") + F.col("indirect")), F.format_string("reach of %d of %d hops", F.col("distance"), F.lit(depth)), F.format_string("%d tests", F.col("tests")))
    return out.select("changed", "direct", "indirect", "distance", "tests", points.cast("long").alias("points"), name.alias("level"), said.alias("reasons"))


def compare(g: Graph, a: str, b: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Two roots side by side: each measure as a text, for a and for b, and whether they differ."""
    roots = g.nodes.sparkSession.createDataFrame([(a,), (b,)], "id string")
    rows = score(g, roots, depth)
    measures = ["direct", "indirect", "distance", "tests", "points", "level"]
    long = rows.select("root", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("string").alias("value")) for m in measures))).alias("x")).select("root", "x.*")
    of = lambda root, name: F.max(F.when(F.col("root") == root, F.col("value"))).alias(name)
    return long.groupBy("measure").agg(of(a, "a"), of(b, "b")).select("measure", "a", "b", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))


def tests_for_change(g: Graph, files: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Per test: entities it covers of those changed or reached, of those changed, and risk, which counts these twice."""
    reached = blast_radius(g, files, depth).select(F.col("target").alias("entity"), F.lit(False).alias("changed"))
    affected = files.select(F.col("id").alias("entity"), F.lit(True).alias("changed")).unionByName(reached)
    found = affected.join(tests_of(g), "entity").groupBy("test").agg(F.count_distinct("entity").alias("covers"), F.count_distinct(F.when(F.col("changed"), F.col("entity"))).alias("directly"))
    return found.select("test", "covers", "directly", (F.col("covers") + F.col("directly")).alias("risk"))

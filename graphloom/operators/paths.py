"""Path operators: bounded trails, their reductions, components, cycles and reachability.

A trail repeats no edge, but may repeat nodes. Every level is one equi-join of narrow rows; many roots share a plan. A cap
bounds what is built, not only what is returned: see first_trails().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_DEPTH, MAX_NODES, MAX_PATHS, check
from ..scratch import counted, written

PATH = ["root", "node", "hops", "node_ids", "rel_types", "edge_keys"]


def expand(edges: DataFrame, roots: DataFrame, max_hops: int = MAX_DEPTH, direction: str = "out", min_hops: int = 1, simple: bool = False, per_root: int | None = None) -> DataFrame:
    """All trails from the roots (column id) along edges (src, type, dst, key). simple: inner nodes are not repeated, a
    return to the root ends a trail. per_root: as many shortest trails of each root, whole levels first."""
    check("max_hops", max_hops, 1, 10)
    if per_root and not simple and min_hops == 1:
        return first_trails(edges, roots, max_hops, direction, per_root)
    steps = _steps(edges, direction)
    empty = F.array().cast("array<string>")
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("hops"), F.array("id").alias("node_ids"), empty.alias("rel_types"), empty.alias("edge_keys"))
    levels = []
    for hops in range(1, max_hops + 1):
        live = level.where(F.col("node") != F.col("root")) if simple and hops > 1 else level
        new = live.join(steps, F.col("node") == F.col("s_")).where(~F.array_contains("edge_keys", F.col("k_")))
        if simple:
            new = new.where((F.col("d_") == F.col("root")) | ~F.array_contains("node_ids", F.col("d_")))
        level = new.select("root", F.col("d_").alias("node"), F.lit(hops).alias("hops"), F.array_append("node_ids", F.col("d_")).alias("node_ids"), F.array_append("rel_types", F.col("t_")).alias("rel_types"), F.array_append("edge_keys", F.col("k_")).alias("edge_keys"))
        if hops < max_hops:
            level = written(level, "level")  # else a task holds the sorts of all joins so far
        if hops >= min_hops:
            levels.append(level)
    out = reduce(DataFrame.unionAll, levels)
    return capped(out, per_root) if per_root else out


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    if direction not in ("out", "in"):
        raise ValueError("direction must be out or in")
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.select(F.col(a).alias("s_"), F.col(b).alias("d_"), F.col("type").alias("t_"), F.col("key").alias("k_"))


def first_steps(edges: DataFrame, direction: str, most: int) -> DataFrame:
    """Each node's first edges, by the node they lead to and their key. Spark keeps that many of each node in each partition
    before it shuffles them, so a hub's edges are not brought together."""
    order = Window.partitionBy("s_").orderBy("d_", "k_")
    return _steps(edges, direction).withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= most).drop("place_")


def first_trails(edges: DataFrame, roots: DataFrame, max_hops: int, direction: str, most: int) -> DataFrame:
    """Each root's first trails by hops, then by text, as capped() of all trails has them, with no more than most trails of a
    root and level kept and (most + max_hops) * most built.

    A root's room is what its shorter trails leave of the cap: where a level fills it, that level is cut by text and the root
    goes no further; so all trails that are gone on from are in the result, fewer than most. Of those that go on from one
    trail, the first ones by text take its node's first edges, but for at most max_hops that the trail has already."""
    steps = written(first_steps(edges, direction, most + max_hops), "steps")
    empty = F.array().cast("array<string>")
    live = roots.select(F.col("id").alias("root")).distinct().select("root", F.col("root").alias("node"), F.array("root").alias("node_ids"), empty.alias("rel_types"), empty.alias("edge_keys"), F.lit(most).alias("room"))
    whole = Window.partitionBy("root")
    order = whole.orderBy(F.array_join("node_ids", ">"), F.array_join("edge_keys", ">"))
    levels = []
    for hops in range(1, max_hops + 1):
        new = live.join(steps, F.col("node") == F.col("s_")).where(~F.array_contains("edge_keys", F.col("k_")))
        new = new.select("root", F.col("d_").alias("node"), F.array_append("node_ids", F.col("d_")).alias("node_ids"), F.array_append("rel_types", F.col("t_")).alias("rel_types"), F.array_append("edge_keys", F.col("k_")).alias("edge_keys"), "room")
        kept = new.withColumn("place", F.row_number().over(order)).where((F.col("place") <= most) & (F.col("place") <= F.col("room")))
        level = kept.withColumn("n", F.count("*").over(whole))
        levels.append(level.select("root", "node", F.lit(hops).alias("hops"), "node_ids", "rel_types", "edge_keys"))
        live = level.where(F.col("room") > F.col("n")).select("root", "node", "node_ids", "rel_types", "edge_keys", (F.col("room") - F.col("n")).cast("int").alias("room"))
    return reduce(DataFrame.unionAll, levels)


def capped(paths: DataFrame, most: int) -> DataFrame:
    """Each root's first paths by hops, then by text."""
    order = Window.partitionBy("root").orderBy("hops", F.array_join("node_ids", ">"), F.array_join("edge_keys", ">"))
    return paths.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def distances(edges: DataFrame, roots: DataFrame, max_hops: int, direction: str = "out") -> DataFrame:
    """(root, node, hops) of the nodes within so many hops of each root (column id), at their least distance; the root itself
    where a way leads back to it. Each level goes on from newly reached nodes alone, so a hub costs its edges, not its trails."""
    check("max_hops", max_hops, 1, 10)
    a, b = {"out": ("src", "dst"), "in": ("dst", "src")}[direction]
    steps = edges.select(F.col(a).alias("s_"), F.col(b).alias("d_")).distinct()
    frontier, seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct(), None
    for hops in range(1, max_hops + 1):
        new = frontier.join(steps, F.col("node") == F.col("s_")).select("root", F.col("d_").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = written(new, "frontier")
        level = frontier.withColumn("hops", F.lit(hops))
        seen = level if seen is None else seen.unionAll(level)
    return seen


def nearest(paths: DataFrame) -> DataFrame:
    """(root, node, hops): reached nodes at their least distance."""
    return paths.groupBy("root", "node").agg(F.min("hops").alias("hops"))


def path_edges(paths: DataFrame) -> DataFrame:
    """(root, key, step): distinct edges of a root's paths, with their first place in one."""
    return paths.select("root", F.posexplode("edge_keys").alias("step", "key")).groupBy("root", "key").agg(F.min("step").alias("step"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """One row for each root and list of nodes: that with the first edge keys."""
    first = F.min_by(F.struct("node", "hops", "rel_types", "edge_keys"), F.array_join("edge_keys", ">")).alias("p")
    # dealt out before they are sorted: else each task sorts what the last join has made of its few edges
    return paths.repartition("root", "node_ids").groupBy("root", "node_ids").agg(first).select("root", "p.node", "p.hops", "node_ids", "p.rel_types", "p.edge_keys")


def merged(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two traversals as one: (root, node, hops) at the least distance, and (root, key, step) of their distinct edges."""
    return nearest(a.unionByName(b)), path_edges(a.unionByName(b))


def traversal(edges: DataFrame, root: DataFrame, depth: int = MAX_DEPTH, limit: int = MAX_PATHS, direction: str = "out") -> DataFrame:
    """A request's trails, shortest first; inward ones end at the root."""
    check("depth", depth, 1, MAX_DEPTH)
    check("limit", limit, 1, MAX_PATHS)
    out = expand(edges, root, depth, direction, per_root=limit)
    return out if direction == "out" else out.withColumn("node_ids", F.reverse("node_ids")).withColumn("rel_types", F.reverse("rel_types")).withColumn("edge_keys", F.reverse("edge_keys"))


def of_labels(found: DataFrame, inside: DataFrame, nodes: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """A neighbourhood's nodes of some labels (all without labels), and the edges with both ends among them."""
    kept = found.join(nodes.where(F.col("label").isin(*labels)).select("id"), "id", "left_semi") if labels else found
    ids = kept.select("id")
    return kept, inside.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst")


def neighbourhood(edges: DataFrame, root: DataFrame, depth: int = 2, nodes: int | None = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hops) that are reached by the edges' direction or against it, root first and nearest first up to a cap (None: all
    of them), and the edges between them. Distances come from frontiers, so a hub costs its edges, and the cap is on nodes alone."""
    if nodes is not None:
        check("nodes", nodes, 1, MAX_NODES)
    both = distances(edges, root, depth, "out").unionAll(distances(edges, root, depth, "in"))
    reached = both.where("node <> root").groupBy("node").agg(F.min("hops").alias("hops")).select(F.col("node").alias("id"), "hops")
    found = root.select("id", F.lit(0).alias("hops")).unionAll(reached)
    found = found if nodes is None else found.orderBy("hops", "id").limit(nodes)
    ids = found.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return found, inside.select("src", "type", "dst")


def trimmed(edges: DataFrame, enough: float = 0.9) -> tuple[DataFrame, int]:
    """Edges (src, dst) without those that start where none ends or end where none starts, again and again while that takes a
    good part of them (what is left of such edges does no harm), and how many there are."""
    edges, before = counted(edges, "links")
    while before:
        starts, ends = edges.select("src").distinct(), edges.select(F.col("dst").alias("src")).distinct()
        kept = edges.join(ends, "src", "left_semi").join(starts.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
        edges, after = counted(kept, "trimmed")
        if after > enough * before:
            return edges, after
        before = after
    return edges, 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the strongly connected components of two nodes or more, named by their largest id.

    Each round colours a node with the largest id that reaches it, by frontiers of nodes whose colour has grown; the nodes
    that reach the one their colour is named by, inside the colour, are its component. Edges between colours and those of
    found components go, the rest is trimmed, and the next round begins. A round takes as many steps as the longest of the
    shortest ways, two at a time; each writes narrow rows of ids."""
    rest, left = trimmed(edges.where("src <> dst").select("src", "dst").distinct())
    found: list[DataFrame] = []
    while left:
        nodes = rest.select(F.col("src").alias("id")).unionAll(rest.select("dst")).distinct()
        colours, grown = nodes.select("id", F.col("id").alias("colour"), F.lit(True).alias("grown")), 1
        while grown:
            colours, grown = counted(_coloured(_coloured(colours, rest), rest), "colours", F.col("grown"))
        of = colours.select("id", "colour")
        same = rest.join(of.select(F.col("id").alias("src"), "colour"), "src").join(of.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").where("colour = c2")
        rest = written(same.select("src", "dst"), "links")
        backward = written(_reached_from(rest, of.where("id = colour").select("id")).join(of, "id").select("id", F.col("colour").alias("component")), "reached")
        found.append(backward.withColumn("n", F.count("*").over(Window.partitionBy("component"))).where("n > 1").select("id", "component"))
        gone = backward.select("id")
        rest = rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        rest, left = trimmed(rest.select("src", "dst"))
    return reduce(DataFrame.unionAll, found) if found else edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)


def _coloured(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """Colours (id, colour, grown) after those that have grown were sent along the edges."""
    sent = colours.where("grown").join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.max("colour").alias("sent"))
    more = F.coalesce(F.col("sent") > F.col("colour"), F.lit(False))
    return colours.join(sent, F.col("id") == F.col("dst"), "left").select("id", F.when(more, F.col("sent")).otherwise(F.col("colour")).alias("colour"), more.alias("grown"))


def _reached_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): the roots and all nodes from which edges (src, dst) lead to one of them."""
    steps = edges.select(F.col("dst").alias("s_"), F.col("src").alias("d_"))
    seen = frontier = written(roots, "seen")
    while True:
        one = frontier.join(steps, F.col("id") == F.col("s_")).select(F.col("d_").alias("id")).distinct()
        two = one.join(steps, F.col("id") == F.col("s_")).select(F.col("d_").alias("id"))
        frontier, n = counted(one.unionAll(two).distinct().join(seen, "id", "left_anti"), "frontier")
        if not n:
            return seen
        seen = seen.unionAll(frontier)


def cycles(edges: DataFrame, max_hops: int = 6, limit: int | None = None) -> DataFrame:
    """Simple cycles of two hops or more, one for each set of members: signature, members in cycle order, length.

    Only edges inside strongly connected components are walked, and a cycle is found once, from the member whose id comes
    first, as no way goes on through an earlier one."""
    check("max_hops", max_hops, 1, 10)
    of = components(edges)
    links = edges.where("src <> dst").select("src", "dst").distinct()
    inside = links.join(of.select(F.col("id").alias("src"), "component"), "src").join(of.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst")
    steps = written(inside.where("component = c2").select(F.col("src").alias("s_"), F.col("dst").alias("d_")), "steps")
    # ids in the order of the joined text, in which a > follows each
    named = lambda c: F.concat(c, F.lit(">"))
    level = steps.where(named(F.col("d_")) > named(F.col("s_"))).select(F.col("s_").alias("root"), F.col("d_").alias("node"), F.array("s_", "d_").alias("members"))
    closed = []
    for hops in range(2, max_hops + 1):
        new = level.join(steps, F.col("node") == F.col("s_"))
        closed.append(new.where(F.col("d_") == F.col("root")).select("members", F.lit(hops).alias("hops")))
        new = new.where((named(F.col("d_")) > named(F.col("root"))) & ~F.array_contains("members", F.col("d_")))
        level = new.select("root", F.col("d_").alias("node"), F.array_append("members", F.col("d_")).alias("members"))
    found = reduce(DataFrame.unionAll, closed) if closed else level.select("members", F.lit(0).alias("hops")).limit(0)
    signed = found.groupBy(F.array_join(F.array_sort("members"), "|").alias("signature")).agg(F.min_by(F.struct("members", "hops"), F.array_join("members", ">")).alias("first"))
    out = signed.select("signature", "first.members", F.col("first.hops").alias("length"))
    return out.orderBy("length", "signature").limit(limit) if limit else out


def reachable(edges: DataFrame, root: DataFrame, direction: str = "in", max_hops: int | None = None) -> DataFrame:
    """(id, hops) of every node that is reached, the root included; levels until none is new."""
    pairs = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    steps = written(reduce(DataFrame.unionAll, [edges.select(F.col(a).alias("s_"), F.col(b).alias("d_")) for a, b in pairs]).distinct(), "steps")
    seen = frontier = written(root.select("id", F.lit(0).alias("hops")), "seen")
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        new = frontier.join(steps, F.col("id") == F.col("s_")).select(F.col("d_").alias("id")).distinct()
        frontier = written(new.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hops)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = written(seen.unionAll(frontier), "seen")
    return seen


def shortest(paths: DataFrame, node: str) -> DataFrame:
    """The shortest path of each root to a node; ties by text."""
    order = Window.partitionBy("root").orderBy("hops", F.array_join("node_ids", ">"))
    return paths.where(F.col("node") == node).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def induced(path: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of paths (root, node_ids) in their order as (root, step, ..), and the edges between the nodes of one path."""
    steps = path.select("root", F.posexplode("node_ids").alias("step", "id")).groupBy("root", "id").agg(F.min("step").alias("step"))
    ends = steps.select("root", "id")
    inside = edges.select("src", "type", "dst").join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), ["root", "dst"])
    return steps.join(nodes, "id"), inside.select("root", "src", "type", "dst").distinct()


def rings(found: DataFrame, gap: float = 160.0) -> DataFrame:
    """found (id, hops) with x and y: the root in the middle, each distance a ring, its nodes by id at equal angles."""
    ring = Window.partitionBy("hops")
    angle = 2 * F.pi() * (F.row_number().over(ring.orderBy("id")) - 1) / F.count("*").over(ring)
    return found.select("*", F.round(F.col("hops") * gap * F.cos(angle), 6).alias("x"), F.round(F.col("hops") * gap * F.sin(angle), 6).alias("y"))


def flow(found: DataFrame, width: float = 240.0, height: float = 80.0) -> DataFrame:
    """found (id, hops) with x and y: a column for each distance, its nodes by id from the top, centred on the root's line."""
    column = Window.partitionBy("hops")
    place = F.row_number().over(column.orderBy("id")) - 1 - (F.count("*").over(column) - 1) / 2
    return found.select("*", (F.col("hops") * width).alias("x"), (place * height).alias("y"))


def force(found: DataFrame, inside: DataFrame, rounds: int = 120, gap: float = 120.0, seed: int = 1) -> DataFrame:
    """found (id, ..) with x and y from forces: nodes push one another away, edges (src, dst) pull, everything drifts to the
    middle. At most MAX_NODES nodes, as of neighbourhood(), are laid out on the driver; the same graph and seed give the same
    places."""
    import numpy as np

    ids = [r["id"] for r in found.select("id").orderBy("id").limit(MAX_NODES + 1).collect()]
    check("nodes", len(ids), 0, MAX_NODES)
    at = {x: k for k, x in enumerate(ids)}
    pairs = sorted({(at[a], at[b]) for a, b in inside.select("src", "dst").collect() if a in at and b in at and a != b})
    ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    place = np.random.default_rng(seed).normal(0.0, gap, (len(ids), 2))
    for k in range(rounds):
        apart = place[:, None, :] - place[None, :, :]
        push = (apart / np.maximum((apart**2).sum(2), 1.0)[:, :, None]).sum(1) * gap**2
        pull, along = np.zeros_like(place), place[ends[:, 1]] - place[ends[:, 0]]
        stretch = along * (np.hypot(*along.T) / gap)[:, None] if len(ends) else along
        np.add.at(pull, ends[:, 0], stretch)
        np.add.at(pull, ends[:, 1], -stretch)
        step = push + pull - 0.05 * place
        most = gap * (1 - k / rounds)
        place = place + step * np.minimum(1.0, most / np.maximum(np.hypot(*step.T), 1e-9))[:, None]
    rows = [(x, round(float(a), 3), round(float(b), 3)) for x, (a, b) in zip(ids, place, strict=True)]
    return found.join(F.broadcast(found.sparkSession.createDataFrame(rows, "id string, x double, y double")), "id")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Ids next to a node, in either direction."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id")).unionAll(edges.where(F.col("dst") == node).select(F.col("src").alias("id")))
    return out.where(F.col("id") != node).distinct()


def spine(paths: DataFrame) -> DataFrame:
    """Each distinct hop (src, dst) of a root's paths in the order of its first occurrence."""
    order = Window.partitionBy("root").orderBy("hops", F.array_join("node_ids", ">"))
    numbered = paths.withColumn("path_no", F.row_number().over(order))
    hops = numbered.select("root", "path_no", F.posexplode(F.arrays_zip(F.slice("node_ids", 1, F.col("hops")).alias("a"), F.slice("node_ids", 2, F.col("hops")).alias("b"))).alias("at", "h"))
    first = hops.groupBy("root", F.col("h.a").alias("src"), F.col("h.b").alias("dst")).agg(F.min(F.struct("path_no", "at")).alias("first"))
    return first.select("root", "src", "dst", F.row_number().over(Window.partitionBy("root").orderBy("first")).alias("step"))

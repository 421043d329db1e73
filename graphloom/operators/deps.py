"""Dependencies, relationships, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import human_label, search_label, up


def node_by_id(g: Graph, node: str) -> DataFrame:
    return g.nodes.where(F.col("id") == node).limit(1)


def label_counts(g: Graph, labels: list[str]) -> DataFrame:
    """One count for each label, zeros included, in one pass."""
    spark = g.nodes.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    counts = g.nodes.groupBy("label").agg(F.count("*").alias("n"))
    return wanted.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def label_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(label, before, after, added) of two tables of counts (label, n), as of label_counts(): what an import has added, never
    below 0; a label that one of them lacks counts 0 there."""
    both = before.select("label", F.col("n").alias("was")).join(after.select("label", F.col("n").alias("now")), "label", "full_outer")
    was, now = F.coalesce("was", F.lit(0)), F.coalesce("now", F.lit(0))
    return both.select("label", was.alias("before"), now.alias("after"), F.greatest(now - was, F.lit(0)).alias("added"))


def mapped(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes of a label as a request returns them: id and the fields of commits, pull requests, issues and tests by their
    outer names; other labels with id, type and title. Missing texts are empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    fields = {
        "Commit": [text("sha").alias("sha"), F.substring(text("sha"), 1, 7).alias("short_sha"), text("message").alias("message"), F.col("ts").alias("committed_at")],
        "PullRequest": [text("title").alias("title"), F.regexp_extract("id", r":(\d+)$", 1).try_cast("long").alias("number"), F.col("ts").alias("created_at")],
        "Issue": [text("title").alias("title"), F.regexp_extract("id", r":(\d+)$", 1).try_cast("long").alias("number"), F.col("ts").alias("created_at")],
        "Test": [text("name").alias("name"), F.coalesce("framework", F.lit("unknown")).alias("framework")],
    }
    return nodes.where(F.col("label") == label).select("id", *fields.get(label, [F.col("label").alias("type"), human_label().alias("title")]))


def edge_count(g: Graph, labels: list[str]) -> DataFrame:
    return g.edges.where(F.col("src_label").isin(*labels) & F.col("dst_label").isin(*labels)).groupBy("type").agg(F.count("*").alias("n"))


def search(g: Graph, text: str, labels: list[str], limit: int) -> DataFrame:
    """Nodes whose search label holds the text, case aside."""
    hits = g.n(*labels).where(F.contains(F.lower(search_label()), F.lit(text.lower())))
    return hits.select("id", "label", human_label().alias("title")).orderBy("title", "id").limit(limit)


def default_repository(g: Graph) -> DataFrame:
    return g.n("Repository").orderBy(F.coalesce("active", F.lit(False)).desc(), up("ts"), "id").limit(1).select("id", "name")


def adjacent(g: Graph, node: str, kind: str, direction: str = "out") -> DataFrame:
    """Callees, callers, imports, importers, parents, children: nodes at the other end, by name."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    ends = g.e(kind).where(F.col(here) == node).select(F.col(there).alias("id"))
    return g.nodes.join(ends, "id", "left_semi").select("id", "label", "name").orderBy(up("name"), "id")


def adjacent_edges(g: Graph, node: str, kind: str, direction: str = "out") -> DataFrame:
    """The edges to what adjacent() gives, with their lines: (src, type, dst, line)."""
    return g.e(kind).where(F.col("src" if direction == "out" else "dst") == node).select("src", "type", "dst", "line").orderBy(up("line"), "src", "dst")


def class_links(g: Graph, direction: str = "out") -> DataFrame:
    """(class, owner, via): what the functions of a class's file call (or are called by), as single-class owner or file."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    members = g.class_members()
    calls = g.e("CALLS").select(F.col(a).alias("fn"), F.col(b).alias("via"))
    owners = g.owners().select(F.col("fn").alias("via"), "owner")
    found = members.join(calls, "fn").join(owners, "via").where(F.col("owner") != F.col("class"))
    return found.groupBy("class", "owner").agg(F.min("via").alias("via"))


def class_dependencies(g: Graph, direction: str = "out") -> DataFrame:
    """class_links and the classes it extends (or that extend it), each pair and type once."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    calls = class_links(g, direction).select("class", "owner", F.lit("CALLS").alias("type"), "via")
    parents = g.e("EXTENDS").select(F.col(a).alias("class"), F.col(b).alias("owner"), F.lit("EXTENDS").alias("type"), F.lit(None).cast("string").alias("via"))
    return calls.unionByName(parents)


def tests_of(g: Graph, containers: bool = False, of: DataFrame | None = None) -> DataFrame:
    """(entity, test): tests of the functions of every function, file and class, and of containers if asked; of those in of (id)
    alone, if it is given."""
    tests = g.e("TESTS").select(F.col("dst").alias("fn"), F.col("src").alias("test"))
    members = g.members(containers=containers)
    members = members if of is None else members.join(of.select(F.col("id").alias("entity")), "entity", "left_semi")
    return members.join(tests, "fn").select("entity", "test").distinct()


def tests_for(g: Graph, entity: str) -> DataFrame:
    """Tests of an entity, be it a function, file, class, directory or repository."""
    found = tests_of(g, True).where(F.col("entity") == entity)
    return g.n("Test").join(found, F.col("id") == F.col("test")).select("id", "name", "framework")


def dependencies(g: Graph, node: str, direction: str = "out") -> DataFrame:
    """(id, label, name, type, via) of what a node depends on (or what depends on it), by its label: a function's callees, a
    file's imports, a class's classes and files; nothing for other labels. Names are those of the targets themselves."""
    label = g.nodes.where(F.col("id") == node).select("label").first()
    kind = label and {"Function": "CALLS", "File": "IMPORTS", "Class": ""}.get(label[0])
    none = F.lit(None).cast("string")
    if kind is None:
        ends = g.edges.limit(0).select(F.col("dst").alias("id"), "type", none.alias("via"))
    elif kind:
        here, there = ("src", "dst") if direction == "out" else ("dst", "src")
        ends = g.e(kind).where(F.col(here) == node).select(F.col(there).alias("id"), "type", none.alias("via"))
    else:
        ends = class_dependencies(g, direction).where(F.col("class") == node).select(F.col("owner").alias("id"), "type", "via")
    return g.nodes.select("id", "label", "name").join(ends.distinct(), "id")


def relationship_list(items: DataFrame, text: str = "", label: str | None = None, order: str = "name") -> DataFrame:
    """Of items (name, label, type, via) those that hold the text, case aside, in any of these, of one label, in order: name,
    name_desc, label or type."""
    orders = {"name": ["name"], "name_desc": [F.desc("name")], "label": ["label", "name"], "type": ["type", "name"]}
    if order not in orders:
        raise ValueError(f"no such order: {order}")
    hit = F.lit(False)
    for c in ("name", "label", "type", "via"):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.strip().lower()))
    out = items.where(hit)
    return (out.where(F.col("label") == label) if label else out).orderBy(*orders[order], "id")


def repository_times(g: Graph) -> DataFrame:
    """The default repository's name and times of creation and update."""
    chosen = default_repository(g).select("id")
    return g.n("Repository").join(chosen, "id", "left_semi").select("id", F.col("name").alias("full_name"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


def resolve_changed(g: Graph, raw: DataFrame, path: str = "path") -> DataFrame:
    """(raw, id, resolved) of changed paths or node ids, each id once: whether the graph has it as a file, class or function."""
    ids = raw.select(F.trim(path).alias("raw"), normal_path(F.col(path)).alias("id")).groupBy("id").agg(F.min("raw").alias("raw"))
    known = g.n("File", "Class", "Function").select("id").withColumn("known", F.lit(True))
    return ids.join(known, "id", "left").select("raw", "id", F.coalesce("known", F.lit(False)).alias("resolved"))


def normal_path(path: Column) -> Column:
    """A changed path as a file id: trimmed, without a/ or b/, the tail of a blob URL, without leading slashes; ids stay."""
    p = F.regexp_replace(F.trim(path), r"^[ab]/", "")
    p = F.regexp_replace(F.regexp_replace(p, r"^.*?/blob/[^/]+/(?=.)", ""), r"^/+", "")
    return F.when(F.trim(path).rlike(r"^(file|fn|dir|class|test|repo|function|directory):"), F.trim(path)).otherwise(F.concat(F.lit("file:"), p))


def incident(g: Graph, node: str) -> DataFrame:
    """All relationships of a node, each once (a loop too), numbered outgoing first."""
    found = g.nodes.where(F.col("id") == node).select("label").first()
    touch = (g.touching(found[0]) if found else g.edges).where((F.col("src") == node) | (F.col("dst") == node)).dropDuplicates(["src", "type", "dst"])
    side = F.when(F.col("src") == node, F.lit("out")).otherwise(F.lit("in"))
    order = Window.orderBy(F.desc("direction"), "type", "src", "dst")
    return touch.select("src", "type", "dst", side.alias("direction")).select("*", F.row_number().over(order).cast("long").alias("n"))


def relationship_summary(g: Graph, kinds: tuple[str, ...] = ("CALLS", "IMPORTS", "EXTENDS")) -> DataFrame:
    """For every function, file and class: distinct neighbours by type and direction, tests, and all incident edges. An edge is
    in the graph once, so that a neighbour is an edge, and nothing is kept to tell them apart."""
    labels = ["Function", "File", "Class"]
    entities = g.n(*labels).select("id")
    ends = lambda here, d, there: g.edges.where(F.col(f"{here}_label").isin(*labels)).select(F.col(here).alias("id"), "type", F.lit(d).alias("d"), F.col(there).alias("o"))
    both = ends("src", "out", "dst").unionAll(ends("dst", "in", "src"))
    counts = [F.count(F.when((F.col("type") == k) & (F.col("d") == d), F.col("o"))).alias(f"{k.lower()}_{d}") for k in kinds for d in ("out", "in")]
    loops = F.sum(F.when((F.col("d") == "in") & (F.col("o") == F.col("id")), 0).otherwise(1)).alias("relationships")
    sums = both.groupBy("id").agg(*counts, loops)
    tests = tests_of(g).groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("tests"))
    out = entities.join(sums, "id", "left").join(tests, "id", "left")
    return out.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c != "id"))


def class_counts(g: Graph, direction: str = "out") -> DataFrame:
    """Distinct classes (else files) that a class's functions call: every class of a file with several counts."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    members = g.class_members()
    calls = g.e("CALLS").select(F.col(a).alias("fn"), F.col(b).alias("o"))
    files = g.e("CONTAINS", src="File", dst="Function").select(F.col("dst").alias("o"), F.col("src").alias("file"))
    classes = g.e("CONTAINS", src="File", dst="Class").select(F.col("src").alias("file"), F.col("dst").alias("c"))
    return members.join(calls, "fn").join(files, "o").join(classes, "file", "left").groupBy("class").agg(F.count_distinct(F.coalesce("c", "file")).alias("n"))

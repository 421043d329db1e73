"""Architecture intelligence: components, orphans, god modules, fragile code, test gaps, knowledge, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import written
from .deps import tests_of
from .history import changes, contributors, entity_files
from .paths import cycles

#: Files that hold no code, in lower case: whole names; names that may go on after a dot; tools whose
#: settings are code; endings of documents, pictures and generated files.
PLAIN_NAMES = ["package.json", "package-lock.json", ".gitignore", ".npmrc", ".editorconfig", "dockerfile", "jsconfig.json"]
NAME_FAMILIES = [".env", ".prettierrc", ".eslintrc"]
TOOLS = ["next", "vitest", "jest", "tailwind"]
ENDINGS = ["md", "markdown", "svg", "png", "jpg", "jpeg", "gif", "ico", "lock", "sum", "map"]


def code_only(path: Column) -> Column:
    """Whether a path is neither a test nor a manifest, setting, document, picture or generated file: by the name's parts."""
    raw = F.split(F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("")), r"\.")
    part = F.transform(raw, F.lower)
    name, count, last = F.array_join(part, "."), F.size(part), F.element_at(part, -1)
    test = (count > 2) & F.get(raw, count - 2).isin("test", "spec")
    family = F.concat(F.lit("."), F.get(part, F.lit(1))).isin(NAME_FAMILIES) & (F.get(part, F.lit(0)) == "")
    typescript = (F.get(part, F.lit(0)) == "tsconfig") & (last == "json") & (count <= 3)
    settings = (count == 3) & F.get(part, F.lit(0)).isin(TOOLS) & (F.get(part, F.lit(1)) == "config") & last.isin("js", "cjs", "mjs", "ts", "cts", "mts")
    document = (count > 1) & (last.isin(ENDINGS) | (last == "ts") & (count > 2) & (F.get(part, count - 2) == "d"))
    return ~F.coalesce(test | name.isin(PLAIN_NAMES) | family | typescript | settings | document, F.lit(False))


def core_components(g: Graph, limit: int) -> DataFrame:
    """Classes by distinct callers of their file's functions, with the first three callers' names."""
    members = g.class_members()
    calls = g.e("CALLS").select(F.col("dst").alias("fn"), F.col("src").alias("caller"))
    names = g.n("Function").select(F.col("id").alias("caller"), F.col("name").alias("caller_name"))
    pairs = members.join(calls, "fn").select("class", "caller").distinct().join(names, "caller")
    first = pairs.select("class", "caller_name").distinct().withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("caller_name"))).where("n <= 3")
    top = first.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "caller_name"))), lambda x: x["caller_name"]), ", ").alias("top"))
    found = pairs.groupBy("class").agg(F.count("*").alias("callers")).join(top, "class").select("class", "callers", "top")
    return found.orderBy(F.desc("callers"), "class").limit(limit)


def featured(g: Graph, limit: int) -> DataFrame:
    """Files by importers and code entities by callers and children, half of the places each, then the best of both."""
    half = -(-limit // 2)
    files = g.e("IMPORTS").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n")).orderBy(F.desc("n"), "id").limit(half)
    code = g.e("CALLS", "EXTENDS").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n")).orderBy(F.desc("n"), "id").limit(half)
    return files.unionByName(code).orderBy(F.desc("n"), "id").limit(limit)


def languages(g: Graph) -> DataFrame:
    """Files, functions and classes by language, and the share of the files in per cent."""
    files = g.n("File").select(F.col("id").alias("src"), F.coalesce("language", F.lit("Unknown")).alias("language"))
    inside = g.e("CONTAINS", src="File").groupBy("src").agg(F.count_distinct(F.when(F.col("dst_label") == "Function", F.col("dst"))).alias("f"), F.count_distinct(F.when(F.col("dst_label") == "Class", F.col("dst"))).alias("c"))
    sums = files.join(inside, "src", "left").groupBy("language").agg(F.count("*").alias("files"), F.sum(F.coalesce("f", F.lit(0))).alias("functions"), F.sum(F.coalesce("c", F.lit(0))).alias("classes"))
    return sums.withColumn("percent", F.round(100 * F.col("files") / F.sum("files").over(Window.partitionBy())).cast("long"))


def _commits_of(g: Graph, entities: DataFrame) -> DataFrame:
    """(id, commits): how many commits modify each entity's file. They are counted for each file, not for each entity of it; only
    entities of several files have their commits told apart."""
    touched = g.e("MODIFIES", src="Commit").select(F.col("src").alias("commit"), F.col("dst").alias("file"))
    files = entity_files(g).withColumnRenamed("entity", "id").join(entities.select("id"), "id", "left_semi").distinct()
    files = written(files.withColumn("n", F.count("*").over(Window.partitionBy("id"))), "files")
    counted = touched.groupBy("file").agg(F.count_distinct("commit").alias("commits"))
    one = files.where("n = 1").join(counted, "file").select("id", "commits")
    several = files.where("n > 1").select("id", "file")
    return one.unionAll(several.join(touched, "file").groupBy("id").agg(F.count_distinct("commit").alias("commits")))


def orphans(g: Graph, strict: bool = False) -> DataFrame:
    """Files, classes and functions without a called member and without importers or children; their tests and commits."""
    entities = g.n("File", "Class", "Function").select("id", "label", "path")
    called = g.members(strict).join(g.e("CALLS").select(F.col("dst").alias("fn")).distinct(), "fn").select(F.col("entity").alias("id"))
    wanted = g.e("IMPORTS", "EXTENDS").select(F.col("dst").alias("id"))
    lone = entities.join(called, "id", "left_anti").join(wanted, "id", "left_anti").where((F.col("label") != "File") | code_only(F.col("path")))
    lone = written(lone.select("id", "label"), "lone")
    tests = tests_of(g, of=lone).groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("tests"))
    commits = _commits_of(g, lone)
    return lone.join(tests, "id", "left").join(commits, "id", "left").select("id", "label", F.coalesce("tests", F.lit(0)).alias("tests"), F.coalesce("commits", F.lit(0)).alias("commits"))


def _class_owners(g: Graph, direction: str) -> DataFrame:
    """(class, owner): distinct owners of the functions that call (in) or are called by (out) a class's functions."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    members = g.class_members()
    calls = g.e("CALLS").select(F.col(a).alias("fn"), F.col(b).alias("other"))
    owners = g.owners().select(F.col("fn").alias("other"), "owner")
    return members.join(calls, "fn").join(owners, "other").where("owner <> class").select("class", "owner").distinct()


def god_modules(g: Graph, limit: int | None = None) -> DataFrame:
    """Classes that are called by many owners and call many: fan-in, fan-out and their product."""
    count = lambda d, name: _class_owners(g, d).groupBy("class").agg(F.count("*").alias(name))
    out = count("in", "fan_in").join(count("out", "fan_out"), "class").withColumn("score", F.col("fan_in") * F.col("fan_out"))
    return out.orderBy(F.desc("score"), "class").limit(limit) if limit else out


def fragile(g: Graph, limit: int | None = None) -> DataFrame:
    """Classes whose file changes often and that many owners call: commits, callers and their product."""
    callers = _class_owners(g, "in").groupBy("class").agg(F.count("*").alias("callers"))
    files = g.e("CONTAINS", src="File", dst="Class").select(F.col("dst").alias("class"), F.col("src").alias("file"))
    commits = g.e("MODIFIES").groupBy(F.col("dst").alias("file")).agg(F.count_distinct("src").alias("commits"))
    out = callers.join(files, "class").join(commits, "file").select("class", "commits", "callers", (F.col("commits") * F.col("callers")).alias("score"))
    return out.orderBy(F.desc("score"), "class").limit(limit) if limit else out


def test_gaps(g: Graph) -> DataFrame:
    """Files with functions of which none is tested; their functions, importers and commits."""
    tested = g.e("TESTS").select(F.col("dst").alias("fn")).distinct().withColumn("t", F.lit(1))
    functions = g.e("CONTAINS", src="File", dst="Function").select(F.col("src").alias("file"), F.col("dst").alias("fn"))
    files = functions.join(tested, "fn", "left").groupBy("file").agg(F.count_distinct("fn").alias("functions"), F.count("t").alias("t")).where("t = 0").drop("t")
    importers = g.e("IMPORTS").groupBy(F.col("dst").alias("file")).agg(F.count_distinct("src").alias("importers"))
    commits = g.e("MODIFIES").groupBy(F.col("dst").alias("file")).agg(F.count_distinct("src").alias("commits"))
    return files.join(importers, "file", "left").join(commits, "file", "left").select("file", "functions", F.coalesce("importers", F.lit(0)).alias("importers"), F.coalesce("commits", F.lit(0)).alias("commits"))


def smells(g: Graph, each: int = 12) -> DataFrame:
    """The first cycles, god modules and fragile classes in one list: kind, subject, size."""
    found = cycles(g.keyed("IMPORTS"), 6, each).select(F.lit("cycle").alias("kind"), F.col("signature").alias("subject"), F.col("length").cast("long").alias("size"))
    god = god_modules(g, each).select(F.lit("god_module").alias("kind"), F.col("class").alias("subject"), F.col("score").alias("size"))
    weak = fragile(g, each).select(F.lit("fragile").alias("kind"), F.col("class").alias("subject"), F.col("score").alias("size"))
    return found.unionByName(god).unionByName(weak)


def entity_knowledge(g: Graph, entity: str) -> DataFrame:
    """Commits and last commit of each developer in an entity's file; of the whole repository for an unknown id."""
    files = entity_files(g).where(F.col("entity") == entity).select("file")
    if files.isEmpty():
        return contributors(g)
    return changes(g).join(files, "file").where("dev IS NOT NULL").groupBy("dev").agg(F.count_distinct("commit").alias("commits"), F.max("ts").alias("last"))


def workspace(g: Graph) -> DataFrame:
    """One row: how many repositories, files, commits, pull requests, issues and developers there are."""
    names = {"repositories": "Repository", "files": "File", "commits": "Commit", "pulls": "PullRequest", "issues": "Issue", "developers": "Developer"}
    return g.n(*names.values()).agg(*(F.count_if(F.col("label") == label).alias(name) for name, label in names.items()))


def composition(g: Graph) -> DataFrame:
    """Files, functions, classes and tests, and their share of the sum in per cent."""
    counts = g.n("File", "Function", "Class", "Test").groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)), 6))

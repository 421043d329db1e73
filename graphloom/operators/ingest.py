"""From extracted rows to nodes and edges: directories, imports, calls, heritage, tests, and links across languages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import extension
from ..functions.parse import parsed
from ..scratch import written

#: Endings that an import may leave out, in the order in which they are tried.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
#: Programs that run a script, and the endings of scripts and of shell scripts.
RUNNERS = ["python", "python3", "node", "npx", "go", "cargo", "java", "php", "dotnet", "ruby"]
SCRIPTS, SHELL = ["py", "js", "ts", "go", "rs", "java", "php", "cs", "rb"], ["sh", "bat", "cmd", "ps1"]
#: What starts another program: reason, languages, names of calls (their last parts).
CALLS = [
    ("exec", ["TypeScript", "JavaScript"], ["exec", "execSync", "execFile", "execFileSync"]),
    ("spawn", ["TypeScript", "JavaScript"], ["spawn", "spawnSync", "fork"]),
    ("subprocess", ["Python"], ["subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.Popen"]),
    ("os.system", ["Python"], ["os.system", "os.popen"]),
    ("Popen", ["Python"], ["Popen"]),
    ("exec.Command", ["Go"], ["exec.Command", "exec.CommandContext"]),
    ("Command", ["Rust"], ["Command::new"]),
    ("Runtime.exec", ["Java"], ["exec"]),
    ("ProcessBuilder", ["Java"], ["ProcessBuilder"]),
    ("shell", ["PHP"], ["exec", "shell_exec", "system", "passthru"]),
    ("proc_open", ["PHP"], ["proc_open"]),
    ("Process.Start", ["C#"], ["Process.Start"]),
]
#: Folders whose scripts a Python or Go file means by their path alone, and beginnings of shell scripts' names.
FOLDERS, TASKS = ["script", "scripts", "bin", "tool", "tools"], ["build", "deploy", "setup", "start", "run", "test", "install", "compile"]
#: Other reasons, after those of CALLS.
STRING, FOLDER, TASK, PLAIN = "script in a string", "script path", "shell script", "build file"


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normal(path: Column) -> Column:
    """A path without . and .. segments; null if it leaves the repository."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", F.lit(None).cast("array<string>")).otherwise(F.array_append(acc, x))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def directories(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The directories (id, path) above files (path), and CONTAINS edges from each to its directories and files."""
    parts = files.select("path", F.split("path", "/").alias("p"))
    above = parts.where("size(p) > 1").select(F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"), "p").select(F.array_join(F.slice("p", 1, F.col("k")), "/").alias("path")).distinct()
    nodes = above.select(F.concat(F.lit("dir:"), "path").alias("id"), "path")
    top = lambda path: F.when(parent(path) == "", F.lit("repo:root")).otherwise(F.concat(F.lit("dir:"), parent(path)))
    inner = above.select(top(F.col("path")).alias("src"), F.lit("CONTAINS").alias("type"), F.concat(F.lit("dir:"), "path").alias("dst"))
    leaves = files.select(top(F.col("path")).alias("src"), F.lit("CONTAINS").alias("type"), F.concat(F.lit("file:"), "path").alias("dst"))
    return nodes, inner.unionAll(leaves)


def _first(candidates: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Of the candidates (keys, k, candidate), each key's first that is a file."""
    hits = candidates.join(files.select(F.col("path").alias("candidate")), "candidate")
    return hits.groupBy(*keys).agg(F.min_by("candidate", "k").alias("to"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, to): the file that an import (path, target) means. Relative targets go by the importer's directory;
    Python's dots, Java's names, Rust's crate paths and PHP's names by their languages' layouts; C#'s names mean no file."""
    source = imports.join(files.select("path", "language"), "path")
    t, here = F.col("target"), parent(F.col("path"))
    scripts = F.when(t.startswith("."), normal(F.concat_ws("/", here, t)))
    dots = F.length(F.regexp_extract(t, r"^(\.*)", 1))
    dotted = F.regexp_replace(F.regexp_replace(t, r"^\.+", ""), r"\.", "/")
    python = F.when(dots > 0, normal(F.concat_ws("/", here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), dotted))).otherwise(dotted)
    java = F.regexp_replace(t, r"\.", "/")
    rust = F.regexp_replace(F.regexp_replace(t, r"^(crate|super|self)::", ""), "::", "/")
    rust = F.when(t.startswith("crate::"), F.concat(F.lit("src/"), rust)).when(t.startswith("super::"), normal(F.concat_ws("/", here, F.lit(".."), rust))).when(t.startswith("self::"), normal(F.concat_ws("/", here, rust)))
    ends = lambda base, some: F.transform(F.array(*map(F.lit, some)), lambda e: F.concat(base, e))
    lang = F.col("language")
    options = (
        F.when(lang.isin("TypeScript", "JavaScript"), ends(scripts, ENDINGS))
        .when(lang == "Python", ends(python, [".py", "/__init__.py"]))
        .when(lang == "Java", F.concat(ends(java, [".java"]), ends(F.concat(F.lit("src/main/java/"), java), [".java"])))
        .when(lang == "Rust", F.concat(ends(rust, [".rs", "/mod.rs"]), ends(F.regexp_replace(rust, r"/[^/]+$", ""), [".rs", "/mod.rs"])))
        .when(lang == "Go", ends(F.when(t.startswith("."), normal(F.concat_ws("/", here, t))), [".go"]))
        .when(lang == "PHP", ends(F.replace(t, F.lit("\\"), F.lit("/")), [".php"]))
    )
    rows = source.select("path", "target", F.posexplode(options).alias("k", "candidate")).where("candidate IS NOT NULL")
    return _first(rows, files, ["path", "target"])


def resolve_calls(calls: DataFrame, symbols: DataFrame, imported: DataFrame, strict: bool = False) -> DataFrame:
    """(path, name, to): the symbol that a bare call means: a function of the same file, else its only symbol of that name,
    else (unless strict) one of an imported file. imported: (path, to)."""
    named = symbols.select(F.col("path").alias("at"), "name", F.col("id").alias("to"), "kind")
    own = calls.join(named, (calls["path"] == named["at"]) & (calls["name"] == named["name"])).select(calls["path"], calls["name"], "to", (F.when(F.col("kind") == "function", 0).otherwise(1)).alias("rank"))
    found = own
    if not strict:
        far = calls.join(imported.select("path", F.col("to").alias("at")).distinct(), "path").join(named, ["at", "name"])
        found = own.unionAll(far.select("path", "name", "to", (F.when(F.col("kind") == "function", 2).otherwise(3)).alias("rank")))
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("path", "name", "rank")))
    usable = counted.where((F.col("rank").isin(0, 2)) | (F.col("n") == 1))
    return usable.groupBy("path", "name").agg(F.min_by("to", F.struct("rank", "to")).alias("to"))


def resolve_parents(heritage: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """(child, parent) ids of classes; the parent's last name part is looked for in the file and in imported files."""
    classes = symbols.where(F.col("kind").isin("class", "struct", "interface", "trait")).select(F.col("path").alias("at"), F.col("name").alias("n"), "id")
    wanted = heritage.select("path", "name", F.element_at(F.split("parent", r"\."), -1).alias("p"))
    places = imported.select("path", F.col("to").alias("at"), F.lit(1).alias("rank")).unionAll(heritage.select("path", F.col("path").alias("at"), F.lit(0).alias("rank"))).distinct()
    hits = wanted.join(places, "path").join(classes, (places["at"] == classes["at"]) & (F.col("p") == F.col("n")))
    best = hits.groupBy(wanted["path"], "name").agg(F.min_by("id", F.struct("rank", "id")).alias("parent"))
    return best.select(F.concat(F.lit("fn:"), "path", F.lit(":"), "name").alias("child"), "parent").where("child <> parent")


def match_tests(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(test, source) files by name, and TESTS edges to every symbol of the source that is no class."""
    base = F.regexp_replace("path", r"\.(spec|test)(\.[^./]+)$", "")
    tests = files.where(F.col("path").rlike(r"\.(spec|test)\.[^./]+$")).select(F.col("path").alias("test"), base.alias("b"))
    rows = tests.select("test", F.posexplode(F.transform(F.array(*map(F.lit, ENDINGS[1:])), lambda e: F.concat("b", e))).alias("k", "candidate"))
    pairs = _first(rows, files, ["test"]).withColumnRenamed("to", "source")
    edges = pairs.join(symbols.where(F.col("kind") != "class"), F.col("source") == F.col("path")).select(F.concat(F.lit("test:"), "test").alias("src"), F.lit("TESTS").alias("type"), F.col("id").alias("dst"))
    return pairs, edges


def framework(content: Column) -> Column:
    return F.when(content.rlike(r"\bfrom ['\"]vitest['\"]"), "vitest").when(content.rlike(r"\b(jest|describe|it|expect)\b.*\("), "jest").when(content.rlike(r"\bimport pytest\b|(?m)^def test_"), "pytest").when(content.rlike(r"org\.junit"), "junit").otherwise("unknown")


def _named(names: list[str]) -> Callable[[Column], Column]:
    """Whether a word is one of the names, or ends with one after a dot."""
    return lambda w: reduce(Column.__or__, [w.endswith(f".{n}") for n in names], w.isin(*names))


def references(files: DataFrame) -> DataFrame:
    """(path, language, t, reason, rank, line): the scripts that files (path, language, content) name, and how. An argument list
    that goes on in the next line is one line; a line is words between white space, quotes, brackets and commas. A script
    after a program that runs it is meant: by the call that stands before it, or in a string, or (a build file) plainly; a
    script after a call of its language, one in a well-known folder, a shell script with a task's name, and what begins with ./ or
    follows a shell are meant without a program."""
    ranks = {r: k for k, r in enumerate([*(c for c, _, _ in CALLS), STRING, FOLDER, TASK, PLAIN])}
    any_of = lambda x, values: x.isin(*values)
    folded = F.regexp_replace("content", r"([,(\[])[ \t]*\r?\n", "$1 ")
    lines = files.where(F.col("content").isNotNull()).select("path", "language", "content", F.explode(F.split(folded, r"\r?\n")).alias("said"))
    lines = lines.where(F.col("said").rlike(rf"\.(?:{'|'.join([*SCRIPTS, *SHELL])})\b"))
    # methods (.arg) and run say nothing between a program and its script
    words = F.filter(F.split("said", r"[\s'\"`,()\[\]{};=]+"), lambda w: (w != "") & (w != "run") & ~w.rlike(r"^\.\w"))
    methods = F.split("said", r"[\s'\"`,()\[\]{};=]+")
    ending, folder = lambda w: F.regexp_extract(w, r"\.(\w+)$", 1), lambda w: F.regexp_extract(w, r"^(?:\./)?([^/]+)/", 1)
    called = F.lit(None).cast("string")
    for reason, languages, names in reversed(CALLS):
        here = any_of(F.col("language"), languages) & F.exists("every", _named(names))
        called = F.when(here, F.lit(reason)).otherwise(called)
    lines = lines.select("path", "language", "content", "said", words.alias("words"), methods.alias("every"))
    lines = lines.withColumn("call", called)
    found = lines.select("path", "language", "content", "said", "call", "words", F.posexplode("words").alias("k", "t")).where(F.col("t").rlike(r"^[\w./-]+$"))
    before = F.coalesce(F.get("words", F.col("k") - 1), F.lit(""))
    script, shell = any_of(ending(F.col("t")), SCRIPTS), any_of(ending(F.col("t")), SHELL)
    quoted = F.col("said").rlike("['\"`]")
    task = F.regexp_extract("t", r"([A-Za-z]+)[^/]*$", 1)
    reason = (
        F.when(script & any_of(before, RUNNERS), F.coalesce("call", F.when(quoted, F.lit(STRING)).otherwise(F.lit(PLAIN))))
        .when(script & F.col("call").isNotNull(), F.col("call"))
        .when(script & quoted & any_of(F.col("language"), ["Python", "Go"]) & any_of(folder(F.col("t")), FOLDERS), F.lit(FOLDER))
        .when(shell & quoted & any_of(task, TASKS), F.lit(TASK))
        .when((script | shell) & (F.col("t").startswith("./") | any_of(before, ["bash", "sh"])), F.lit(PLAIN))
    )
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), F.col("reason"))
    line = F.size(F.split(F.call_function("substring_index", F.col("content"), F.col("t"), F.lit(1)), "\n"))
    return found.withColumn("reason", reason).where("reason IS NOT NULL").select("path", "language", "t", "reason", rank.alias("rank"), line.alias("line")).distinct()


def cross_language(files: DataFrame) -> DataFrame:
    """(src, dst, reason, line): files that refer to a known file of another language, each pair once, at its first line of
    the first kind of reference. A path is looked for beside the file and from the root."""
    found = references(files)
    near, rooted = normal(F.concat_ws("/", parent(F.col("path")), F.col("t"))), normal(F.col("t"))
    tried = found.select("path", "language", "rank", "reason", "line", F.explode(F.array(near, rooted)).alias("dst")).where("dst IS NOT NULL")
    targets = files.select(F.col("path").alias("dst"), F.col("language").alias("other"))
    hits = tried.join(targets, "dst").where(F.col("language") != F.col("other"))
    return hits.groupBy(F.col("path").alias("src"), "dst").agg(F.min(F.struct("rank", "line", "reason")).alias("m")).select("src", "dst", "m.reason", "m.line")


def shared_names(files: DataFrame, most: int | None = 20) -> DataFrame:
    """(a, b): files of one directory with one base name and different languages, where the directory is not too full (None: however full)."""
    known = files.where(F.col("language") != "Unknown").select("path", "language", parent(F.col("path")).alias("dir"), F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1).alias("base"))
    some = known
    if most is not None:
        dirs = known.groupBy("dir").agg(F.count("*").alias("n"), F.count_distinct("language").alias("l")).where((F.col("n") <= most) & (F.col("l") >= 2)).select("dir")
        some = known.join(dirs, "dir", "left_semi")
    other = some.select("dir", "base", F.col("path").alias("b"), F.col("language").alias("lb"))
    return some.join(other, ["dir", "base"]).where((F.col("path") < F.col("b")) & (F.col("language") != F.col("lb"))).select(F.col("path").alias("a"), "b")


#: Labels of symbols by kind.
LABELS = {"class": "Class", "interface": "Interface", "type": "Interface", "enum": "Enum", "struct": "Struct", "trait": "Trait", "module": "Module", "function": "Function", "method": "Function"}
CLASSES = ("class", "interface", "struct", "trait", "enum")


def _picked(symbols: DataFrame, some: Column | None = None) -> DataFrame:
    """(at, short, id): what a short name means in a file: its function of that name, else its only symbol so named."""
    rows = (symbols.where(some) if some is not None else symbols).select(F.col("path").alias("at"), F.element_at(F.split("name", r"\."), -1).alias("short"), "id", "kind")
    sums = rows.groupBy("at", "short").agg(F.min(F.when(F.col("kind") == "function", F.col("id"))).alias("fn"), F.min("id").alias("one"), F.count("*").alias("n"))
    return sums.select("at", "short", F.coalesce("fn", F.when(F.col("n") == 1, F.col("one"))).alias("id")).where("id IS NOT NULL")


def resolve_scoped(rows: DataFrame, symbols: DataFrame, bindings: DataFrame, classes: bool = False) -> DataFrame:
    """rows (path, name, ..) with the column to, the id of the symbol that a name means; those that mean none are left out.
    A bare name: a symbol of the file, else what is imported by that name. a.b: the method b of the file's class a, a symbol
    b of the file imported as a, or the method b of the class imported as a. this and self stand for nothing. bindings:
    (path, local, imported, to); classes: only classes are meant."""
    kind = F.col("kind").isin(*CLASSES) if classes else None
    picked, named = written(_picked(symbols, kind), "picked"), symbols.select(F.col("path").alias("at"), F.col("name").alias("full"), "id")
    keys = rows.select("path", "name").distinct().withColumn("p", F.split("name", r"\."))
    keys = keys.where((F.size("p") <= 2) & ~F.get("p", F.lit(0)).isin("this", "self", "cls", "super"))
    bare, pair = keys.where("size(p) = 1").select("path", "name"), keys.where("size(p) = 2").select("path", "name", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    local = bindings.select("path", "local", "imported", F.col("to").alias("at"))
    meant = F.when(F.col("imported").isin("default", "*", ""), F.col("local")).otherwise(F.col("imported"))
    far = lambda df, by: df.join(local.withColumnRenamed("local", by), ["path", by])
    tries = [
        bare.join(picked, (F.col("path") == F.col("at")) & (F.col("name") == F.col("short"))).select("path", "name", "id", F.lit(0).alias("rank")),
        bare.join(local.withColumn("short", meant), (bare["path"] == local["path"]) & (F.col("name") == F.col("local"))).select(bare["path"], "name", "at", "short").join(picked, ["at", "short"]).select("path", "name", "id", F.lit(1).alias("rank")),
        pair.join(named, (F.col("path") == F.col("at")) & (F.col("full") == F.col("name"))).select("path", "name", "id", F.lit(0).alias("rank")),
        far(pair, "a").where("imported = '*'").withColumnRenamed("b", "short").join(picked, ["at", "short"]).select("path", "name", "id", F.lit(1).alias("rank")),
        far(pair, "a").where("imported <> '*'").select("path", "name", "at", F.concat(F.when(F.col("imported") == "default", F.col("a")).otherwise(F.col("imported")), F.lit("."), "b").alias("full")).join(named, ["at", "full"]).select("path", "name", "id", F.lit(2).alias("rank")),
    ]
    best = reduce(DataFrame.unionAll, tries).groupBy("path", "name").agg(F.min_by("id", F.struct("rank", "id")).alias("to"))
    return rows.join(best, ["path", "name"])


def assemble(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name, path, language, framework, line) and edges (src, type, dst, line) of files (path, language, content):
    directories, files and symbols; imports, calls between symbols by the function that makes them, heritage, tests and
    links across languages, with their lines. An edge whose end is unknown is left out; each node and edge comes once."""
    files = files.select("path", "language", "content")
    rows = written(parsed(files), "parsed")
    symbols = rows.where(F.col("kind").isin(*LABELS)).groupBy("path", "name").agg(F.min_by(F.struct("kind", "line"), F.struct("line", "kind")).alias("s"))
    symbols = written(symbols.select(F.concat(F.lit("fn:"), "path", F.lit(":"), "name").alias("id"), "path", "name", "s.kind", "s.line"), "symbols")
    wanted = rows.where("kind = 'import'")
    resolved = written(resolve_imports(wanted.select("path", "target").distinct(), files), "resolved")
    bindings = wanted.select("path", "target", F.col("name").alias("local"), F.col("scope").alias("imported")).join(resolved, ["path", "target"])
    calls = resolve_scoped(rows.where("kind = 'call' AND scope <> ''").select("path", "name", "scope", "line"), symbols, bindings)
    above = rows.where("kind IN ('extends', 'implements')").select("path", F.col("name").alias("child"), F.col("target").alias("name"), "kind", "line")
    above = resolve_scoped(above, symbols, bindings, classes=True)
    names = rows.where("kind = 'test'").select("path", "name", "line")
    tools = files.select("path", framework(F.col("content")).alias("framework"))
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    pairs, tested = match_tests(files, symbols)
    holders, contains = directories(files)
    file = lambda c: F.concat(F.lit("file:"), c)
    none = F.lit(None).cast("string")
    node = lambda df, label, name, path=none, language=none, tool=none, line=F.lit(None).cast("int"): df.select("id", label.alias("label"), name.alias("name"), path.alias("path"), language.alias("language"), tool.alias("framework"), line.alias("line"))
    last = F.element_at(F.split("path", "/"), -1)
    tests = names.join(tools, "path")
    nodes = [
        node(files.sparkSession.range(1).select(F.lit("repo:root").alias("id")), F.lit("Repository"), F.lit("root")),
        node(holders, F.lit("Directory"), last, F.col("path")),
        node(files.withColumn("id", file("path")), F.lit("File"), last, F.col("path"), F.col("language")),
        node(symbols, F.element_at(label, F.col("kind")), F.col("name"), F.col("path"), line=F.col("line")),
        node(pairs.select(F.col("test").alias("path")).join(tools, "path").withColumn("id", F.concat(F.lit("test:"), "path")), F.lit("Test"), last, F.col("path"), tool=F.col("framework")),
        node(tests.withColumn("id", F.concat(F.lit("test:"), "path", F.lit(":"), "name")), F.lit("Test"), F.col("name"), F.col("path"), tool=F.col("framework"), line=F.col("line")),
    ]
    edge = lambda df, a, kind, b: df.select(a.alias("src"), kind.alias("type"), b.alias("dst"), (F.col("line") if "line" in df.columns else F.lit(None)).cast("int").alias("line"))
    symbol = lambda c: F.concat(F.lit("fn:"), "path", F.lit(":"), c)
    edges = [
        edge(contains, F.col("src"), F.col("type"), F.col("dst")),
        edge(symbols, file("path"), F.lit("CONTAINS"), F.col("id")),
        edge(names, file("path"), F.lit("CONTAINS"), F.concat(F.lit("test:"), "path", F.lit(":"), "name")),
        edge(wanted.select("path", "target", "line").join(resolved.where("path <> to"), ["path", "target"]), file("path"), F.lit("IMPORTS"), file("to")),
        edge(calls, symbol("scope"), F.lit("CALLS"), F.col("to")),
        edge(above, symbol("child"), F.upper("kind"), F.col("to")),
        edge(tested, F.col("src"), F.col("type"), F.col("dst")),
        edge(cross_language(files), file("src"), F.lit("CROSS_LANGUAGE"), file("dst")),
    ]
    return reduce(DataFrame.unionAll, nodes).dropDuplicates(["id"]), reduce(DataFrame.unionAll, edges).where("src <> dst").groupBy("src", "type", "dst").agg(F.min("line").alias("line"))


def file_nodes(files: DataFrame) -> DataFrame:
    return files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("File").alias("label"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", extension(F.col("path")).alias("extension"), "language", "hash")

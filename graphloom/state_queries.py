"""Queries of stored states, changes, seeds and sources of several languages, each with DuckDB SQL of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing
from .graph import Graph
from .operators import ingest, sync
from .operators.search import Index
from .operators.store import Store
from .plans.projection import duckdb, load
from .queries import _register, query
from .scratch import shared_dir


def _number(c: Column) -> Column:
    return F.element_at(F.split(c, ":"), 2).cast("long")


# versions

_HELD = "SELECT src, 'MODIFIES' AS type, dst FROM e_modifies WHERE dst LIKE '%0'"


def _versions(g: Graph) -> Store:
    """Files but each third one, with imports and some of the commits that modify them; then the others are added with their imports,
    each fifth is renamed and some imports go, each seventh goes but for what a commit holds; then the whole is compacted."""
    store = Store(g.nodes.sparkSession, f"{shared_dir(g.nodes.sparkSession)}/graphloom-store-{uuid.uuid4().hex}")
    files, k = g.n("File").select("id", "label", "name"), _number(F.col("id"))
    imports = g.e("IMPORTS").select("src", "type", "dst")
    held = g.e("MODIFIES").where("dst LIKE '%0'").select("src", "type", "dst")
    first = files.where(k % 3 != 0)
    ids = first.select("id")
    inside = imports.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst")
    store.promote(first, inside.unionAll(held))
    act = lambda df, action: df.select("id", F.lit(action).alias("action"))
    others = files.where(k % 3 == 0)
    store.apply(act(others, "ADDED"), others, imports.withColumn("action", F.lit("ADDED")), "query", 1)
    renamed = files.where(k % 5 == 1).withColumn("name", F.concat("name", F.lit(" II")))
    store.apply(act(renamed, "UPDATED"), renamed, imports.where(_number(F.col("src")) % 5 == 2).withColumn("action", F.lit("REMOVED")), "query", 2)
    store.apply(act(files.where(k % 7 == 2), "REMOVED"), files.limit(0), None, "query", 3)
    store.compact()
    return store


_STATES = f"""f AS (SELECT id, name, CAST(split_part(id, ':', 2) AS BIGINT) AS k FROM n_file), h AS ({_HELD}), i AS (SELECT src, 'IMPORTS' AS type, dst FROM e_imports),
    v AS (SELECT unnest(range(5)) AS version),
    n AS (SELECT version, id, CASE WHEN version >= 2 AND k % 5 = 1 THEN name || ' II' ELSE name END AS name FROM f, v WHERE (version > 0 OR k % 3 <> 0) AND (version < 3 OR k % 7 <> 2 OR id IN (SELECT dst FROM h)))"""


@query(f"WITH {_STATES} SELECT version, id, name FROM n")
def stored_nodes(g: Graph) -> DataFrame:
    """Every version of a store that is kept as deltas, and the compacted one"""
    store = _versions(g)
    return _each(store, 0).select("version", "id", "name")


@query(f"""WITH {_STATES} SELECT version, i.src, i.type, i.dst FROM v, i WHERE i.src IN (SELECT id FROM n WHERE n.version = v.version) AND i.dst IN (SELECT id FROM n WHERE n.version = v.version)
    AND (version < 2 OR CAST(split_part(i.src, ':', 2) AS BIGINT) % 5 <> 2) UNION ALL SELECT version, src, type, dst FROM v, h""")
def stored_edges(g: Graph) -> DataFrame:
    """Edges of removed nodes go, a commit's edges stay"""
    return _each(_versions(g), 1).select("version", "src", "type", "dst")


def _each(store: Store, which: int) -> DataFrame:
    out = [store.read(v)[which].withColumn("version", F.lit(v).cast("long")) for v in range(store.version() + 1)]
    some = out[0]
    for df in out[1:]:
        some = some.unionByName(df, allowMissingColumns=True)
    return some


# search

_FOUND = """SELECT id, label, coalesce(nullif(name, ''), nullif(title, ''), nullif(list_last(string_split(path, '/')), ''), nullif(sha, ''), nullif(username, ''), nullif(message, ''), id) AS title FROM all_nodes
    WHERE label IN ('File', 'Class', 'Function', 'PullRequest') AND contains(lower(coalesce(name, title, sha, username, message, '')), '{}') ORDER BY 3, 1 LIMIT 40"""


@query(_FOUND.format("11"))
def search_by_index(g: Graph) -> DataFrame:
    """From the index of grams, two characters"""
    return Index(g.n("File", "Class", "Function", "PullRequest")).search("11", ["File", "Class", "Function", "PullRequest"], 40)


@query(_FOUND.format("supplier#00000000"))
def search_by_long_text(g: Graph) -> DataFrame:
    """Fifteen triples, intersected"""
    return Index(g.n("File", "Class", "Function", "PullRequest")).search("Supplier#00000000", ["File", "Class", "Function", "PullRequest"], 40)


# changes

_PATHS = "SELECT id FROM n_file WHERE path LIKE 'src/1/%' OR path LIKE 'src/3/%'"


def _code(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = g.n("File", "Function", "Class").select("id", "label", "path")
    edges = g.e("CONTAINS", src="File").unionAll(g.e("IMPORTS")).select("src", "type", "dst")
    return nodes, edges, g.n("File").where("path LIKE 'src/1/%' OR path LIKE 'src/3/%'").select("path")


_GONE = f"gone AS ({_PATHS} UNION SELECT dst FROM e_contains WHERE src IN ({_PATHS}))"


@query(f"WITH {_GONE} SELECT src, type, dst FROM (SELECT src, 'CONTAINS' AS type, dst FROM e_contains WHERE src LIKE 'file:%' UNION ALL SELECT src, 'IMPORTS', dst FROM e_imports) x WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def edges_after_removal(g: Graph) -> DataFrame:
    """Files of two directories go with what they contain"""
    return sync.remove_files(*_code(g))[1].select("src", "type", "dst")


@query(f"WITH {_GONE} SELECT label, count(*) AS n FROM all_nodes WHERE label IN ('File', 'Function', 'Class') AND id NOT IN (SELECT id FROM gone) GROUP BY label")
def labels_after_removal(g: Graph) -> DataFrame:
    """N22"""
    return sync.remove_files(*_code(g))[0].groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {_GONE} SELECT id FROM gone UNION ALL SELECT src || '>' || dst FROM (SELECT src, dst FROM e_contains WHERE src LIKE 'file:%' UNION ALL SELECT src, dst FROM e_imports) x WHERE src IN (SELECT id FROM gone)")
def old_state(g: Graph) -> DataFrame:
    """What is stored of two directories, and the edges that leave it"""
    nodes, edges = sync.old_state(*_code(g))
    return nodes.select("id").unionAll(edges.select(F.concat_ws(">", "src", "dst")))


@query("SELECT f.path, md5(f.path) AS hash FROM n_file f JOIN contained k ON k.file = f.id WHERE k.repo = 'repo:1' AND f.language IS NOT NULL")
def stored_hashes(g: Graph) -> DataFrame:
    """SC15: of a repository's files that have one"""
    nodes = g.n("File").withColumn("hash", F.when(F.col("language").isNotNull(), F.md5("path")))
    return sync.stored_hashes(nodes, g.contained(), "repo:1")


@query("SELECT id, id = 'repo:2' AS active FROM n_repository")
def activated(g: Graph) -> DataFrame:
    """Exactly one repository is active"""
    return sync.activate(g.n("Repository"), "repo:2").select("id", "active")


@query("SELECT id, CASE WHEN CAST(split_part(id, ':', 2) AS BIGINT) % 4 = 1 THEN name || ' b' WHEN CAST(split_part(id, ':', 2) AS BIGINT) % 2 = 1 THEN name || ' a' ELSE name END AS name FROM n_file UNION ALL SELECT 'new:' || id, name FROM n_repository")
def upserted(g: Graph) -> DataFrame:
    """The last of several new rows of a key holds"""
    files, k = g.n("File").select("id", "name"), _number(F.col("id"))
    new = files.where(k % 2 == 1).select("id", F.concat("name", F.lit(" a")).alias("name"), F.lit(1).alias("at"))
    new = new.unionAll(files.where(k % 4 == 1).select("id", F.concat("name", F.lit(" b")), F.lit(2)))
    return sync.upsert(files, new.unionAll(g.n("Repository").select(F.concat(F.lit("new:"), "id"), "name", F.lit(1))), ["id"])


@query("SELECT src, 'IMPORTS' AS type, dst FROM e_imports WHERE src IN (SELECT id FROM n_file WHERE language IS NOT NULL) AND dst IN (SELECT id FROM n_file WHERE language IS NOT NULL)")
def edges_with_both_ends(g: Graph) -> DataFrame:
    """A graph from raw tables with repeated nodes and edges, some of whose ends are missing"""
    nodes = g.n("File").where("language IS NOT NULL")
    edges = g.e("IMPORTS").select("src", "type", "dst")
    return Graph.loaded(nodes.unionAll(nodes), edges.unionAll(edges)).edges.select("src", "type", "dst")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").alias("expires_at"))


_register("sessions_left", lambda spark, d: sync.purge(_sessions(spark, d), "2024-01-15 00:00:00").select("event_id"), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")

# seeds

_U32 = "& 4294967295"
_MUL = f"((({{0}} & 65535) * ({{1}}) + ((({{0}} >> 16) * ({{1}})) & 65535) * 65536) {_U32})"


def _seeded_sql(n: int) -> str:
    t1, t2 = _MUL.format("xor(a, a >> 15)", "(a | 1)"), _MUL.format("xor(t, t >> 7)", "(t | 61)")
    return f"""SELECT id, hash, {n} AS n, xor(u, u >> 14) / 4294967296.0 AS value FROM (SELECT *, xor((t + {t2}) {_U32}, t) AS u FROM (SELECT *, {t1} AS t FROM (SELECT *, (hash + {n}::BIGINT * 1831565813) {_U32} AS a
        FROM (SELECT id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) {_U32}) AS hash FROM n_file) w) x) y) z"""


@query(f"{_seeded_sql(1)} UNION ALL {_seeded_sql(2)} UNION ALL {_seeded_sql(3)}")
def seeded_numbers(g: Graph) -> DataFrame:
    """FNV-1a of each file's name, and the first three numbers of mulberry32 from it"""
    hashed = g.n("File").select("id", hashing.fnv1a(F.col("name")).alias("hash"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    return hashed.select("id", "hash", F.col("n").cast("long").alias("n"), hashing.seeded(F.col("hash"), F.col("n")).alias("value"))


# sources of several languages

_TONGUES = ["TypeScript", "Python", "Go", "Rust", "Java", "PHP", "C#", "Unknown"]
_EXTENSIONS = ["ts", "py", "go", "rs", "java", "php", "cs", "mk"]
_CALLS = ["execSync('node %s');", "os.system('python %s')", '\texec.Command("python", "%s")', 'Command::new("node").arg("%s");', 'Runtime.getRuntime().exec("node %s");', "shell_exec('node %s');", 'Process.Start("python", "%s");', "\tpython %s"]
_REASONS = ["exec", "os.system", "exec.Command", "Command", "Runtime.exec", "shell", "Process.Start", "build file"]


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, in eight languages by turns, that starts each file it imports in its language's way, a line each."""
    g = load(spark, sf_dir)
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % 8 + 1).cast("int"))
    path = lambda k: F.concat(F.lit("s"), (k % 5).cast("string"), F.lit("/f"), k.cast("string"), F.lit("."), of(_EXTENSIONS, k))
    links = g.e("IMPORTS").select(_number(F.col("src")).alias("a"), _number(F.col("dst")).alias("b")).distinct()
    said = links.select("a", F.struct("b", F.replace(of(_CALLS, F.col("a")), F.lit("%s"), path(F.col("b"))).alias("text")).alias("line"))
    texts = said.groupBy("a").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "\n").alias("content"))
    files = g.n("File").select(_number(F.col("id")).alias("a"))
    return files.join(texts, "a", "left").select(path(F.col("a")).alias("path"), of(_TONGUES, F.col("a")).alias("language"), F.coalesce("content", F.lit("")).alias("content"))


_PATH = f"'s' || ({{0}} % 5) || '/f' || {{0}} || '.' || ({_EXTENSIONS})[{{0}} % 8 + 1]"
_register(
    "cross_language_edges",
    lambda spark, d: ingest.cross_language(_spoken(spark, d)).select("src", "dst", "reason", F.col("line").cast("long").alias("line")),
    duckdb(f"""WITH i AS (SELECT DISTINCT CAST(split_part(src, ':', 2) AS BIGINT) AS a, CAST(split_part(dst, ':', 2) AS BIGINT) AS b FROM e_imports WHERE src IN (SELECT id FROM n_file)), l AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS line FROM i)
    SELECT {_PATH.format('a')} AS src, {_PATH.format('b')} AS dst, ({_REASONS})[a % 8 + 1] AS reason, line FROM l WHERE a % 8 <> b % 8 AND b % 8 <> 7 AND 'file:' || b IN (SELECT id FROM n_file)"""),
)


def _tested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files of suppliers, each third with a test beside it, and their parts as symbols, each fourth a class."""
    g = load(spark, sf_dir)
    files = g.n("File").select(_number(F.col("id")).alias("k"))
    paths = files.select(F.format_string("src/f%d.ts", "k").alias("path")).unionAll(files.where("k % 3 = 0").select(F.format_string("src/f%d.spec.ts", "k")))
    inside = g.e("CONTAINS", src="File", dst="Function").select(_number(F.col("src")).alias("k"), _number(F.col("dst")).alias("p"))
    return paths, inside.select(F.format_string("src/f%d.ts", "k").alias("path"), F.format_string("fn:src/f%d.ts:p%d", "k", "p").alias("id"), F.when(F.col("p") % 4 == 0, F.lit("class")).otherwise(F.lit("function")).alias("kind"))


_register(
    "matched_tests",
    lambda spark, d: ingest.match_tests(*_tested(spark, d))[1],
    duckdb("""WITH h AS (SELECT CAST(split_part(src, ':', 2) AS BIGINT) AS k, CAST(split_part(dst, ':', 2) AS BIGINT) AS p FROM e_contains WHERE dst LIKE 'fn:%' AND src IN (SELECT id FROM n_file))
    SELECT 'test:src/f' || k || '.spec.ts' AS src, 'TESTS' AS type, 'fn:src/f' || k || '.ts:p' || p AS dst FROM h WHERE k % 3 = 0 AND p % 4 <> 0"""),
)

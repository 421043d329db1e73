"""The property graph that the TPC-H-like tables stand for, stated once in SQL that Spark and DuckDB both read.

Braces hold table names. Spark puts DataFrames in their place, DuckDB its views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph

#: Nodes by label: id, name and the label's own columns.
NODES = {
    "Repository": "SELECT concat('repo:', cast(r_regionkey AS string)) AS id, r_name AS name, r_regionkey = 0 AS active FROM {region}",
    "Directory": "SELECT concat('dir:', cast(n_nationkey AS string)) AS id, n_name AS name, concat('/', lower(n_name)) AS path FROM {nation}",
    "File": """SELECT concat('file:', cast(s_suppkey AS string)) AS id, s_name AS name, concat('src/', cast(s_nationkey AS string), '/', s_name) AS path,
        CASE s_suppkey % 4 WHEN 0 THEN 'TypeScript' WHEN 1 THEN 'Python' WHEN 2 THEN 'Go' ELSE NULL END AS language FROM {supplier}""",
    "Function": "SELECT concat('fn:', cast(p_partkey AS string)) AS id, p_name AS name FROM {part}",
    "Class": """SELECT concat('class:', cast(s_suppkey AS string), ':1') AS id, concat('A', cast(s_suppkey AS string)) AS name FROM {supplier} WHERE s_suppkey % 3 >= 1
        UNION ALL SELECT concat('class:', cast(s_suppkey AS string), ':2') AS id, concat('B', cast(s_suppkey AS string)) AS name FROM {supplier} WHERE s_suppkey % 3 = 2""",
    "Commit": """SELECT concat('commit:', cast(o_orderkey AS string)) AS id, cast(o_orderkey AS string) AS sha, o_orderpriority AS message, o_orderdate AS ts FROM {orders}
        WHERE o_orderpriority LIKE '1-%' AND o_orderkey IN (SELECT l_orderkey FROM {lineitem})""",
    "Developer": "SELECT concat('dev:', cast(c_custkey AS string)) AS id, c_name AS name, concat('u', cast(c_custkey AS string)) AS username FROM {customer}",
    "PullRequest": """SELECT concat('pr:', cast(o_custkey * 10000 + year(o_orderdate) AS string)) AS id, concat('PR of ', cast(o_custkey AS string)) AS title, max(o_orderdate) AS ts FROM {orders}
        WHERE o_orderpriority LIKE '1-%' AND o_orderkey IN (SELECT l_orderkey FROM {lineitem}) GROUP BY o_custkey, year(o_orderdate)""",
    "Issue": "SELECT concat('issue:', cast(event_id AS string)) AS id, event_type AS title, ts FROM {events} WHERE event_type = 'error'",
    "Test": "SELECT concat('test:', cast(event_id AS string)) AS id, concat('test ', cast(event_id AS string)) AS name, CASE event_id % 3 WHEN 0 THEN 'jest' WHEN 1 THEN 'pytest' ELSE 'junit' END AS framework FROM {events} WHERE event_type = 'view'",
}

_COMMITS = "SELECT o_orderkey, o_custkey, o_orderdate FROM {orders} WHERE o_orderpriority LIKE '1-%' AND o_orderkey IN (SELECT l_orderkey FROM {lineitem})"
_PAIR = """SELECT DISTINCT concat('{kind}:', cast(a.{key} AS string)) AS src, concat('{kind}:', cast(b.{key} AS string)) AS dst FROM {{lineitem}} a JOIN {{lineitem}} b ON a.l_orderkey = b.l_orderkey
    WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_returnflag = 'R' AND a.{key} <> b.{key}"""
_FIRST = "SELECT s_suppkey AS k FROM {supplier} WHERE s_suppkey % 3 >= 1"

#: Edges by (type, label of the source, label of the target).
EDGES = {
    ("CONTAINS", "Repository", "Directory"): "SELECT concat('repo:', cast(n_regionkey AS string)) AS src, concat('dir:', cast(n_nationkey AS string)) AS dst FROM {nation}",
    ("CONTAINS", "Directory", "File"): "SELECT concat('dir:', cast(s_nationkey AS string)) AS src, concat('file:', cast(s_suppkey AS string)) AS dst FROM {supplier}",
    ("CONTAINS", "File", "Function"): "SELECT concat('file:', cast(p_partkey % n AS string)) AS src, concat('fn:', cast(p_partkey AS string)) AS dst FROM {part} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) s",
    ("CONTAINS", "File", "Class"): """SELECT concat('file:', cast(s_suppkey AS string)) AS src, concat('class:', cast(s_suppkey AS string), ':1') AS dst FROM {supplier} WHERE s_suppkey % 3 >= 1
        UNION ALL SELECT concat('file:', cast(s_suppkey AS string)) AS src, concat('class:', cast(s_suppkey AS string), ':2') AS dst FROM {supplier} WHERE s_suppkey % 3 = 2""",
    ("CONTAINS", "PullRequest", "Commit"): f"SELECT concat('pr:', cast(o_custkey * 10000 + year(o_orderdate) AS string)) AS src, concat('commit:', cast(o_orderkey AS string)) AS dst FROM ({_COMMITS}) c",
    ("EXTENDS", "Class", "Class"): f"""SELECT concat('class:', cast(a.k AS string), ':1') AS src, concat('class:', cast(b.k AS string), ':1') AS dst FROM ({_FIRST}) a JOIN ({_FIRST}) b
        ON b.k = cast((a.k - a.k % 2) / 2 AS bigint) WHERE a.k <> b.k
        UNION SELECT concat('class:', cast(a.k AS string), ':1') AS src, concat('class:', cast(b.k AS string), ':1') AS dst FROM ({_FIRST}) a JOIN ({_FIRST}) b ON b.k = a.k + 1 WHERE a.k % 5 = 1""",
    ("CALLS", "Function", "Function"): _PAIR.format(kind="fn", key="l_partkey"),
    ("IMPORTS", "File", "File"): _PAIR.format(kind="file", key="l_suppkey") + " AND b.l_quantity >= 44",
    ("MODIFIES", "Commit", "File"): f"SELECT DISTINCT concat('commit:', cast(o_orderkey AS string)) AS src, concat('file:', cast(l_suppkey AS string)) AS dst FROM ({_COMMITS}) c JOIN {{lineitem}} l ON o_orderkey = l_orderkey",
    ("AUTHORED_BY", "Commit", "Developer"): f"SELECT concat('commit:', cast(o_orderkey AS string)) AS src, concat('dev:', cast(o_custkey AS string)) AS dst FROM ({_COMMITS}) c",
    ("RELATED_TO", "Issue", "PullRequest"): f"""SELECT concat('issue:', cast(event_id AS string)) AS src, concat('pr:', cast(number AS string)) AS dst FROM {{events}} e
        JOIN (SELECT DISTINCT o_custkey * 10000 + year(o_orderdate) AS number FROM ({_COMMITS}) c) p ON number = user_id * 10000 + 1995 + event_id % 7 WHERE event_type = 'error'""",
    ("TESTS", "Test", "Function"): """SELECT concat('test:', cast(event_id AS string)) AS src, concat('fn:', cast(event_id % p AS string)) AS dst FROM {events} CROSS JOIN (SELECT count(*) AS p FROM {part}) x
        CROSS JOIN (SELECT count(*) AS s FROM {supplier}) y WHERE event_type = 'view' AND event_id % p % s % 4 <> 0""",
}

#: Columns of the union of all nodes.
COLUMNS = {"id": "string", "label": "string", "name": "string", "title": "string", "path": "string", "sha": "string", "username": "string", "message": "string", "language": "string", "framework": "string", "active": "boolean", "ts": "timestamp"}


def _tables(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


def load(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph as lazy DataFrames; a query scans only the tables of the labels and types that it reads."""
    tables: dict[str, DataFrame] = {}

    def run(sql: str) -> DataFrame:
        for t in _tables(sql):
            tables.setdefault(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        return spark.sql(sql, **{t: tables[t] for t in _tables(sql)})

    return Graph.of({label: lambda sql=sql: run(sql) for label, sql in NODES.items()}, {kind: lambda sql=sql: run(sql) for kind, sql in EDGES.items()}, COLUMNS)


def duckdb(body: str) -> str:
    """body after the CTEs that it names: n_<label> and e_<type>, nodes and edges, contained, owner."""
    ctes: list[tuple[str, str]] = []

    def need(name: str) -> None:
        if name in dict(ctes):
            return
        sql = _cte(name)
        for other in _names(sql):
            if other != name:
                need(other)
        ctes.append((name, sql))

    for name in _names(body):
        need(name)
    head = ", ".join(f"{n} AS ({s})" for n, s in ctes)
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    rest = body.replace("RECURSIVE", "").strip()
    if rest.startswith("WITH "):
        return f"WITH {recursive}{head}, {rest[5:]}" if head else f"WITH {recursive}{rest[5:]}"
    return f"WITH {recursive}{head} {rest}" if head else rest


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\b(n_(?:repository|directory|file|function|class|commit|developer|pullrequest|issue|test)|e_(?:contains|extends|calls|imports|modifies|authored_by|related_to|tests)|all_nodes|all_edges|contained|owner)\b", sql)))


def _cte(name: str) -> str:
    plain = lambda sql: re.sub(r"\{(\w+)\}", r"\1", sql)
    if name == "all_nodes":
        parts = []
        for label, sql in NODES.items():
            have = set(re.findall(r"AS (\w+)[,\s]", sql + " ")) | ({"ts"} if label == "Issue" else set())
            parts.append("SELECT " + ", ".join(f"'{label}' AS label" if c == "label" else c if c in have else f"cast(NULL AS {t}) AS {c}" for c, t in COLUMNS.items()) + f" FROM ({plain(sql)}) x")
        return " UNION ALL ".join(parts)
    if name == "all_edges":
        return " UNION ALL ".join(f"SELECT src, '{t}' AS type, dst, '{a}' AS src_label, '{b}' AS dst_label FROM ({plain(sql)}) x" for (t, a, b), sql in EDGES.items())
    if name == "contained":  # of repositories, at most four hops down; the graph is no deeper than three
        return """SELECT r.src AS repo, d.dst AS file FROM e_contains r JOIN e_contains d ON r.dst = d.src WHERE r.src LIKE 'repo:%'"""
    if name == "owner":
        return """SELECT f.dst AS fn, CASE WHEN count(c.dst) = 1 THEN max(c.dst) ELSE f.src END AS owner FROM e_contains f
            LEFT JOIN e_contains c ON c.src = f.src AND c.dst LIKE 'class:%' WHERE f.dst LIKE 'fn:%' GROUP BY f.src, f.dst"""
    if name.startswith("n_"):
        return plain(next(sql for label, sql in NODES.items() if label.lower() == name[2:]))
    found = [(k, sql) for k, sql in EDGES.items() if k[0].lower() == name[2:]]
    return " UNION ALL ".join(f"SELECT src, dst FROM ({plain(sql)}) x" for _, sql in found)

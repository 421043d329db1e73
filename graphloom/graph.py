"""A labelled property graph as DataFrames.

Defined results, of the operators over it as well: an empty graph, and an id that no node has, give no rows (or counts of
0); an edge with a null end joins nothing; null names and paths are no hit of a search or a rule and come last in an order;
ties are broken by id; loaded() keeps each node and edge once, of() expects that; columns beyond those named are not looked
at, and helper columns of an operator do not reach its result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import edge_key
from .scratch import written


def _line(edges: DataFrame) -> Column:
    return (F.col("line") if "line" in edges.columns else F.lit(None)).cast("int").alias("line")


class Graph:
    """nodes: id, label and properties. edges: src, type, dst, src_label, dst_label, identified by (src, type, dst), and line,
    where in the source's file the edge was first found, or null. The graph is kept as one table for each label and kind of edge, so that a query plans and scans only what it names."""

    def __init__(self, nodes: dict[str, Callable[[], DataFrame]], edges: dict[tuple[str, str, str], Callable[[], DataFrame]]):
        self._nodes, self._edges = nodes, edges
        self._keyed: dict[tuple[str, ...], DataFrame] = {}

    @classmethod
    def of(cls, nodes: dict[str, Callable[[], DataFrame]], edges: dict[tuple[str, str, str], Callable[[], DataFrame]], columns: dict[str, str]) -> Graph:
        """From a maker of a DataFrame for each label and each kind of edge; missing columns of nodes are null."""

        def node(label: str, df: DataFrame) -> DataFrame:
            return df.select(*(F.lit(label).alias("label") if c == "label" else F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))

        def edge(kind: tuple[str, str, str], df: DataFrame) -> DataFrame:
            return df.select("src", F.lit(kind[0]).alias("type"), "dst", F.lit(kind[1]).alias("src_label"), F.lit(kind[2]).alias("dst_label"), _line(df))

        return cls({k: lambda k=k, f=f: node(k, f()) for k, f in nodes.items()}, {k: lambda k=k, f=f: edge(k, f()) for k, f in edges.items()})

    @classmethod
    def loaded(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """From raw tables: the first node of an id (by its other columns in order), edges once, and only those with both
        ends. Where the edges lack the labels of their ends, these are looked up."""
        rest = [c for c in nodes.columns if c != "id"]
        nodes = nodes.groupBy("id").agg(F.min(F.struct(*rest)).alias("first")).select("id", "first.*")
        edges = edges.select("src", "type", "dst", _line(edges)).groupBy("src", "type", "dst").agg(F.min("line").alias("line"))
        ends = nodes.select("id", "label")
        edges = edges.join(ends.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(ends.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
        return cls({"": lambda: nodes}, {("", "", ""): lambda: edges.select("src", "type", "dst", "src_label", "dst_label", "line")})

    @property
    def nodes(self) -> DataFrame:
        return reduce(DataFrame.unionAll, [f() for f in self._nodes.values()])

    @property
    def edges(self) -> DataFrame:
        return reduce(DataFrame.unionAll, [f() for f in self._edges.values()])

    def n(self, *labels: str) -> DataFrame:
        if "" in self._nodes:
            return self.nodes.where(F.col("label").isin(*labels))
        some = [f() for k, f in self._nodes.items() if k in labels]
        return reduce(DataFrame.unionAll, some) if some else self.nodes.limit(0)

    def e(self, *types: str, src: str | None = None, dst: str | None = None) -> DataFrame:
        if ("", "", "") in self._edges:
            out = self.edges.where(F.col("type").isin(*types))
            out = out.where(F.col("src_label") == src) if src else out
            return out.where(F.col("dst_label") == dst) if dst else out
        some = [f() for (t, a, b), f in self._edges.items() if t in types and src in (None, a) and dst in (None, b)]
        return reduce(DataFrame.unionAll, some) if some else self.edges.limit(0)

    def touching(self, label: str) -> DataFrame:
        """The edges of those kinds that start or end at nodes of a label; other tables are not read."""
        if ("", "", "") in self._edges:
            return self.edges
        some = [f() for (_, a, b), f in self._edges.items() if label in (a, b)]
        return reduce(DataFrame.unionAll, some) if some else self.edges.limit(0)

    def keyed(self, *types: str) -> DataFrame:
        """Edges with their keys, as a table: a traversal joins them once for each level."""
        if types not in self._keyed:
            self._keyed[types] = written(self.e(*types).select("src", "type", "dst", edge_key().alias("key")), "edges")
        return self._keyed[types]

    def contained(self, max_hops: int = 4, root_label: str = "Repository") -> DataFrame:
        """(root, id, label, hops): what a node of root_label contains within a bound of hops; deeper entities are absent."""
        contains = self.e("CONTAINS").select(F.col("src").alias("s_"), F.col("dst").alias("d_"), F.col("dst_label").alias("l_"), F.col("src_label").alias("sl_"))
        level = contains.where(F.col("sl_") == root_label).select(F.col("s_").alias("root"), F.col("d_").alias("id"), F.col("l_").alias("label"))
        levels = [level.withColumn("hops", F.lit(1))]
        inner = contains.where(F.col("sl_").isin("Directory", "File", "Class"))
        for k in range(2, max_hops + 1):
            level = level.join(inner, F.col("id") == F.col("s_")).select("root", F.col("d_").alias("id"), F.col("l_").alias("label"))
            levels.append(level.withColumn("hops", F.lit(k)))
        return reduce(DataFrame.unionAll, levels)

    def file_of(self) -> DataFrame:
        """(id, file): the file that contains a function or class."""
        return self.e("CONTAINS", src="File").where(F.col("dst_label").isin("Function", "Class")).select(F.col("dst").alias("id"), F.col("src").alias("file"))

    def owners(self) -> DataFrame:
        """(fn, owner): a function's only class, if its file has just one, else the file."""
        classes = self.e("CONTAINS", src="File", dst="Class").groupBy("src").agg(F.min("dst").alias("class"), F.count_distinct("dst").alias("n")).withColumnRenamed("src", "file")
        functions = self.e("CONTAINS", src="File", dst="Function").select(F.col("dst").alias("fn"), F.col("src").alias("file"))
        return functions.join(classes, "file", "left").select("fn", F.when(F.col("n") == 1, F.col("class")).otherwise(F.col("file")).alias("owner"))

    def members(self, strict: bool = False, containers: bool = False) -> DataFrame:
        """(entity, label, fn): functions of a function, file or class; a class has its file's functions (none if strict).
        containers: those of directories and repositories too, at most four hops down."""
        own = self.n("Function").select(F.col("id").alias("entity"), F.lit("Function").alias("label"), F.col("id").alias("fn"))
        functions = self.e("CONTAINS", src="File", dst="Function").select(F.col("src").alias("entity"), F.lit("File").alias("label"), F.col("dst").alias("fn"))
        out = own.unionAll(functions)
        if not strict:
            classes = self.e("CONTAINS", src="File", dst="Class").select(F.col("src").alias("entity"), F.col("dst").alias("class"))
            out = out.unionAll(functions.join(classes, "entity").select(F.col("class").alias("entity"), F.lit("Class").alias("label"), "fn"))
        for label in ("Directory", "Repository") if containers else ():
            out = out.unionAll(self.contained(4, label).where(F.col("label") == "Function").select(F.col("root").alias("entity"), F.lit(label).alias("label"), F.col("id").alias("fn")))
        return out

    def class_members(self) -> DataFrame:
        """(class, fn): the functions of each class's file."""
        return self.members().where(F.col("label") == "Class").select(F.col("entity").alias("class"), "fn")

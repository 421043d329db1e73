"""Guardrails: rules that forbid or require a way between two selections of nodes, and import cycles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import written
from .paths import cycles

MAX_RULE_DEPTH, CYCLE_DEPTH = 5, 10
#: Rules in a word of bits.
BITS = 60


def glob(pattern: str) -> str:
    """A glob as a pattern of the whole text: ** for anything, * for anything but a slash."""
    return "^(?:" + ".*".join(part.replace("*", "[^/]*") for part in pattern.split("**")) + ")$"


@dataclass(frozen=True)
class Selector:
    pattern: str
    mode: str = "glob"  # or exact, prefix

    def fits(self, column: Column) -> Column:
        if self.mode == "exact":
            return column == self.pattern
        if self.mode == "prefix":
            return column.startswith(self.pattern)
        if self.mode == "glob":
            return column.rlike(glob(self.pattern))
        raise ValueError(f"no such mode: {self.mode}")


@dataclass(frozen=True)
class Rule:
    id: str
    source: Selector
    target: Selector
    relationship: str = "IMPORTS"
    severity: str = "ERROR"
    max_depth: int = 1
    enabled: bool = True


def _masks(fits: list[Column], word: str = "word", mask: str = "mask") -> Column:
    """An array of (word, mask): which of so many conditions hold, as bits of words of BITS each."""
    words = []
    for at in range(0, len(fits), BITS):
        bits = [F.when(F.coalesce(f, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, f in enumerate(fits[at : at + BITS])]
        words.append(F.struct(F.lit(at // BITS).alias(word), reduce(Column.bitwiseOR, bits).alias(mask)))
    return F.filter(F.array(*words), lambda x: x[mask] != 0)


def violations(g: Graph, rules: list[Rule], on: str = "path") -> DataFrame:
    """(rule, severity, source, target, hops): ways that a rule forbids, the shortest of each pair.

    All rules share one traversal. A rule is a bit; a frontier row (source, node) carries the bits of the rules under which the
    node is newly reached, an edge lets those of its kind pass, a level those that go as deep. Rules beyond BITS are further words,
    and a row is of one word. So a level is one join and one written table, however many rules there are."""
    live = [r for r in rules if r.enabled]
    if not live:
        return g.edges.limit(0).select(F.lit("").alias("rule"), F.lit("").alias("severity"), F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(0).cast("long").alias("hops"))
    named = g.nodes.select("id", F.col(on).alias("text"))
    marks = written(named.select("id", _masks([r.source.fits(F.col("text")) for r in live]).alias("starts"), _masks([r.target.fits(F.col("text")) for r in live]).alias("ends")), "marks")
    ends = marks.select(F.col("id").alias("node"), F.inline("ends").alias("word", "ends"))
    depth = [min(max(r.max_depth, 1), MAX_RULE_DEPTH) for r in live]
    kinds = sorted({r.relationship for r in live})
    words = range(-(-len(live) // BITS))

    def where(holds: list[bool]) -> list[int]:
        return [sum(1 << k for k, h in enumerate(holds[BITS * w : BITS * (w + 1)]) if h) for w in words]

    passed = F.create_map(*(F.lit(x) for t in kinds for w, m in zip(words, where([r.relationship == t for r in live]), strict=True) for x in (f"{t}|{w}", m)))
    steps = written(g.e(*kinds).select(F.col("src").alias("s_"), F.col("dst").alias("d_"), F.col("type").alias("t_")).distinct(), "steps")
    frontier = marks.select(F.col("id").alias("root"), F.col("id").alias("node"), F.inline("starts").alias("word", "mask"))
    seen, found = None, []
    for hops in range(1, max(depth) + 1):
        deep = F.element_at(F.array(*map(F.lit, where([d >= hops for d in depth]))), F.col("word") + 1)
        mask = F.col("mask").bitwiseAND(F.element_at(passed, F.concat_ws("|", "t_", "word"))).bitwiseAND(deep)
        new = frontier.join(steps, F.col("node") == F.col("s_")).select("root", F.col("d_").alias("node"), "word", mask.cast("long").alias("mask")).where("mask <> 0")
        new = new.groupBy("root", "node", "word").agg(F.bit_or("mask").alias("mask"))
        if seen is not None:
            before = seen.groupBy("root", "node", "word").agg(F.bit_or("mask").alias("before"))
            new = new.join(before, ["root", "node", "word"], "left").select("root", "node", "word", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("before", F.lit(0).cast("long")))).alias("mask")).where("mask <> 0")
        frontier = written(new, "frontier")
        seen = frontier if seen is None else seen.unionAll(frontier)
        hit = frontier.where("root <> node").join(ends, ["node", "word"]).select("root", "node", "word", F.col("mask").bitwiseAND(F.col("ends")).alias("mask")).where("mask <> 0")
        found.append(hit.withColumn("hops", F.lit(hops)))
    each = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.call_function("shiftright", F.col("mask"), k).bitwiseAND(F.lit(1)) != 0)
    known = F.array(*(F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity")) for r in live))
    rows = reduce(DataFrame.unionAll, found).select("root", "node", "hops", "word", F.explode(each).alias("k"))
    return rows.select(F.element_at(known, F.col("word") * BITS + F.col("k") + 1).alias("r"), "root", "node", "hops").select("r.rule", "r.severity", F.col("root").alias("source"), F.col("node").alias("target"), F.col("hops").cast("long").alias("hops"))


def severities(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("violations"), F.count_distinct("rule").alias("rules"))


def dashboard(rules: list[Rule], found: DataFrame) -> DataFrame:
    """(rule, severity, enabled, violations, sources, status): every rule, FAIL where it is violated, OFF where it is disabled."""
    spark = found.sparkSession
    known = spark.createDataFrame([(r.id, r.severity, r.enabled) for r in rules], "rule string, severity string, enabled boolean")
    sums = found.groupBy("rule").agg(F.count("*").alias("violations"), F.count_distinct("source").alias("sources"))
    out = known.join(F.broadcast(sums), "rule", "left")  # at most as many rows as there are rules
    count = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(~F.col("enabled"), F.lit("OFF")).when(count("violations") > 0, F.lit("FAIL")).otherwise(F.lit("PASS"))
    return out.select("rule", "severity", "enabled", count("violations").alias("violations"), count("sources").alias("sources"), status.alias("status"))


def recent(evaluations: DataFrame, limit: int = 10) -> DataFrame:
    """The newest evaluations (repo, id, ts, ..) of each repository, numbered from the newest."""
    order = Window.partitionBy("repo").orderBy(F.desc("ts"), "id")
    return evaluations.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def forbidden_cycles(g: Graph, scope: Selector, kinds: tuple[str, ...] = ("IMPORTS",), depth: int = CYCLE_DEPTH, on: str = "path") -> DataFrame:
    """Simple cycles whose members all are in scope."""
    ids = g.nodes.where(scope.fits(F.col(on))).select("id")
    edges = g.keyed(*kinds).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return cycles(edges, depth)

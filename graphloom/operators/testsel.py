"""Test selection: tests of changed files, directly and through calls, scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .paths import distances

#: Points, and the levels.
DIRECT, SAME_FILE, NEAR, FAR, HISTORY, FLAKY = 50, 40, 20, 10, 10, -10
HIGH, MEDIUM, RUNS, PASS, FLAKINESS = 50, 20, 5, 0.95, 0.3
#: How a framework is run.
COMMANDS = {"jest": "npx jest", "pytest": "pytest", "junit": "mvn test"}


def select(g: Graph, files: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(test, score, level, distance): tests for changed files (column id). A test of one of their functions is direct;
    others are reached by a call or two. metrics: (test, runs, failures, pass_rate, flakiness)."""
    symbols = g.e("CONTAINS", src="File", dst="Function").join(files.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    tests = g.e("TESTS").select(F.col("src").alias("test"), F.col("dst").alias("fn"))
    direct = tests.join(symbols.withColumnRenamed("id", "fn"), "fn", "left_semi").select("test", F.lit(0).alias("distance"))
    reached = distances(g.e("CALLS"), symbols, 2).groupBy(F.col("node").alias("fn")).agg(F.min("hops").alias("distance"))
    found = direct.unionByName(tests.join(reached, "fn").select("test", "distance")).groupBy("test").agg(F.min("distance").cast("long").alias("distance"))
    # tests that stand in a changed file, where the graph knows their files, follow
    beside = g.e("CONTAINS", src="File", dst="Test").join(files.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("test")).distinct().withColumn("beside", F.lit(SAME_FILE))
    found = found.join(beside, "test", "full_outer")
    near = F.when(F.col("distance") == 0, DIRECT + SAME_FILE).when(F.col("distance") == 1, NEAR).when(F.col("distance") == 2, FAR).otherwise(0)
    score = F.when(F.col("distance") == 0, near).otherwise(near + F.coalesce("beside", F.lit(0)))
    if metrics is not None:
        found = found.join(metrics, "test", "left")
        score += F.when((F.col("runs") >= RUNS) & (F.col("failures") > 0) & (F.col("pass_rate") < PASS), HISTORY).otherwise(0)
        score += F.when(F.col("flakiness") > FLAKINESS, FLAKY).otherwise(0)
    level = F.when(F.col("score") >= HIGH, F.lit("HIGH")).when(F.col("score") >= MEDIUM, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    return found.withColumn("score", score.cast("long")).select("test", "score", level.alias("level"), "distance")


def plan(g: Graph, files: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """What select() gives, or every test if it gives none."""
    chosen = select(g, files, metrics)
    if not chosen.isEmpty():
        return chosen
    return g.n("Test").select(F.col("id").alias("test"), F.lit(0).cast("long").alias("score"), F.lit("LOW").alias("level"), F.lit(None).cast("long").alias("distance"))


def reduction(g: Graph, chosen: DataFrame) -> DataFrame:
    """One row: all tests, the chosen ones, and by how many per cent these are fewer (null without tests)."""
    total = g.n("Test").agg(F.count("*").alias("total"))
    some = chosen.agg(F.count_distinct("test").alias("selected"))
    percent = F.when(F.col("total") > 0, F.round((F.col("total") - F.col("selected")) / F.col("total") * 100, 6))
    return total.crossJoin(F.broadcast(some)).select("total", "selected", percent.alias("reduction"))  # one row each


def command_of(framework: Column) -> Column:
    return F.coalesce(*(F.when(framework == k, F.lit(v)) for k, v in COMMANDS.items()), F.lit("npm test"))


def suite(g: Graph, metrics: DataFrame | None = None) -> DataFrame:
    """Tests by framework: how many, how many resolve to a function, the distinct files of these, flaky ones by metrics (as
    select() takes them), and the command."""
    files = g.file_of().select(F.col("id").alias("dst"), "file")
    resolved = g.e("TESTS").select(F.col("src").alias("id"), "dst").join(files, "dst", "left")
    resolved = g.n("Test").select("id", "framework").join(resolved, "id").groupBy("framework").agg(F.count_distinct("id").alias("resolved"), F.count_distinct("file").alias("files"))
    tests = g.n("Test").select("id", "framework")
    tests = tests.join(metrics.select(F.col("test").alias("id"), (F.col("flakiness") > FLAKINESS).alias("f")), "id", "left") if metrics is not None else tests.withColumn("f", F.lit(False))
    sums = tests.groupBy("framework").agg(F.count("*").alias("tests"), F.count_if("f").alias("flaky"))
    out = sums.join(resolved, sums["framework"].eqNullSafe(resolved["framework"]), "left")
    return out.select(sums["framework"], "tests", F.coalesce("resolved", F.lit(0)).alias("resolved"), F.coalesce("files", F.lit(0)).alias("files"), "flaky", command_of(sums["framework"]).alias("command"))

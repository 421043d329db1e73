"""Ownership: who knows a file, from decaying signals of commits, and of reviews where there are such inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from .history import changes

#: Weights of signals, half-life and bounds in days, rows of a signal, and the levels.
RECENT, OLDER, PR_AUTHOR, PR_REVIEW = 35.0, 20.0, 15.0, 15.0
HALF_LIFE, RECENT_DAYS, STALE_DAYS, COMMITS, PULLS = 90, 90, 180, 100, 50
HIGH, MEDIUM = 60.0, 30.0


def signals(g: Graph, as_of: str, authors: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """(file, dev, signal, ts, points): a file's newest commits, decayed by age; authors and reviews: (file, dev, ts)."""
    days = F.greatest(F.datediff(F.lit(as_of).cast("timestamp"), "ts"), F.lit(0))
    newest = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("ts"), "commit"))
    commits = changes(g).where("dev IS NOT NULL").select("file", "dev", "ts", "commit").distinct().withColumn("n", newest).where(F.col("n") <= COMMITS)
    recent = days <= RECENT_DAYS
    out = commits.select("file", "dev", F.when(recent, F.lit("RECENT_COMMIT")).otherwise(F.lit("COMMIT")).alias("signal"), "ts", (F.when(recent, RECENT).otherwise(OLDER) * F.pow(F.lit(0.5), days / HALF_LIFE)).alias("points"))
    for extra, name, weight in ((authors, "PR_AUTHOR", PR_AUTHOR), (reviews, "PR_REVIEW", PR_REVIEW)):
        if extra is not None:
            rows = extra.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("ts"), "dev"))).where(F.col("n") <= PULLS)
            out = out.unionByName(rows.select("file", "dev", F.lit(name).alias("signal"), "ts", F.lit(weight).alias("points")))
    return out


def candidates(g: Graph, as_of: str, authors: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """Each file's developers by score, at most 100: score, level, rank, and the last signal's time."""
    sums = signals(g, as_of, authors, reviews).groupBy("file", "dev").agg(F.round(F.least(F.lit(100.0), F.sum("points")), 6).alias("score"), F.count("*").alias("evidence"), F.max("ts").alias("last"))
    level = F.when(F.col("score") >= HIGH, F.lit("HIGH")).when(F.col("score") >= MEDIUM, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    return sums.withColumn("level", level).withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "dev")).cast("long"))


def evidence(g: Graph, as_of: str) -> DataFrame:
    return signals(g, as_of).groupBy("file", "dev", "signal").agg(F.count("*").alias("n"))


def overview(g: Graph, as_of: str) -> DataFrame:
    """Each file that is no test: contributors, top level, and whether it is single-handed, unclear, stale or well covered."""
    files = g.n("File").where(~F.contains("path", F.lit("test")) & ~F.contains("path", F.lit("spec"))).select(F.col("id").alias("file"))
    sums = candidates(g, as_of).groupBy("file").agg(F.count("*").alias("devs"), F.max("score").alias("top"), F.max("last").alias("last"))
    out = files.join(sums, "file", "left").withColumn("devs", F.coalesce("devs", F.lit(0)))
    stale = F.coalesce(F.datediff(F.lit(as_of).cast("timestamp"), "last") > STALE_DAYS, F.lit(True))
    return out.select("file", "devs", (F.col("devs") == 1).alias("single"), F.coalesce(F.col("top") < MEDIUM, F.lit(True)).alias("unclear"), stale.alias("stale"), ((F.col("devs") >= 2) & ~stale).alias("covered"))


def expertise(g: Graph, reviews: DataFrame | None = None) -> DataFrame:
    """Per developer: commits, distinct files, the ten first paths, the five first areas (two path segments), and reviews
    (file, dev, ts), if given; a developer who only reviews has no row."""
    paths = g.n("File").select(F.col("id").alias("file"), "path", F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("area"))
    known = changes(g).where("dev IS NOT NULL").join(paths, "file")
    sums = known.groupBy("dev").agg(F.count_distinct("commit").alias("commits"), F.count_distinct("file").alias("files"))
    # the first ones by a window over distinct values, so that no developer's paths are gathered
    first = lambda c, most: known.select("dev", c).distinct().withColumn("n", F.row_number().over(Window.partitionBy("dev").orderBy(c))).where(F.col("n") <= most).groupBy("dev").agg(F.array_join(F.array_sort(F.collect_list(c)), ",").alias(f"{c}s"))
    out = sums.join(first("path", 10), "dev").join(first("area", 5), "dev")
    if reviews is None:
        return out.withColumn("reviews", F.lit(0).cast("long"))
    return out.join(reviews.groupBy("dev").agg(F.count("*").alias("reviews")), "dev", "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))

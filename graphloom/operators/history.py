"""Engineering history: commits, pull requests and issues behind files; contributors and change frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph


def changes(g: Graph) -> DataFrame:
    """(file, commit, ts, dev): a row for each file that a commit modifies; dev is null without an author."""
    commits = g.n("Commit").select(F.col("id").alias("commit"), "ts", "sha", "message")
    touched = g.e("MODIFIES").select(F.col("src").alias("commit"), F.col("dst").alias("file"))
    authors = g.e("AUTHORED_BY", src="Commit").select(F.col("src").alias("commit"), F.col("dst").alias("dev"))
    return touched.join(commits, "commit").join(authors, "commit", "left")


def entity_files(g: Graph) -> DataFrame:
    """(entity, file): the file of a function, class or file."""
    return g.file_of().select(F.col("id").alias("entity"), "file").unionAll(g.n("File").select(F.col("id").alias("entity"), F.col("id").alias("file")))


def commits_of(g: Graph, entity: str, limit: int) -> DataFrame:
    files = entity_files(g).where(F.col("entity") == entity).select("file").distinct()
    return changes(g).join(files, "file").select("commit", "ts", "dev").distinct().orderBy(F.desc("ts"), "commit").limit(limit)


def pulls_of(g: Graph, entity: str, limit: int) -> DataFrame:
    files = entity_files(g).where(F.col("entity") == entity).select("file").distinct()
    commits = changes(g).join(files, "file").select(F.col("commit").alias("dst")).distinct()
    pulls = g.e("CONTAINS", src="PullRequest").join(commits, "dst").select(F.col("src").alias("id")).distinct()
    return g.n("PullRequest").join(pulls, "id").select("id", "title", "ts").orderBy(F.desc("ts"), "id").limit(limit)


def issues_of(g: Graph, entity: str, limit: int) -> DataFrame:
    files = entity_files(g).where(F.col("entity") == entity).select("file").distinct()
    commits = changes(g).join(files, "file").select(F.col("commit").alias("dst")).distinct()
    pulls = g.e("CONTAINS", src="PullRequest").join(commits, "dst").select(F.col("src").alias("pr")).distinct()
    issues = g.e("RELATED_TO").join(pulls, F.col("dst") == F.col("pr")).select(F.col("src").alias("id")).distinct()
    return g.n("Issue").join(issues, "id").select("id", "title", "ts").orderBy(F.desc("ts"), "id").limit(limit)


def bundle(g: Graph, roots: DataFrame, commits: int = 10, pulls: int = 5, issues: int = 5) -> DataFrame:
    """(root, kind, rank, id, title, ts): the newest commits, pull requests and issues behind the files of each root (column
    id), so many of each."""
    files = entity_files(g).join(roots.select(F.col("id").alias("entity")), "entity").select(F.col("entity").alias("root"), "file").distinct()
    found = files.join(changes(g), "file").select("root", "commit", "ts", F.concat_ws(" ", "sha", "message").alias("title")).distinct()
    requests = found.select("root", F.col("commit").alias("dst")).join(g.e("CONTAINS", src="PullRequest").select(F.col("src").alias("id"), "dst"), "dst").select("root", "id").distinct()
    related = requests.select("root", F.col("id").alias("dst")).join(g.e("RELATED_TO").select(F.col("src").alias("id"), "dst"), "dst").select("root", "id").distinct()
    some = [
        (found.select("root", F.col("commit").alias("id"), "title", "ts"), "commit", commits),
        (requests.join(g.n("PullRequest").select("id", "title", "ts"), "id").select("root", "id", "title", "ts"), "pull", pulls),
        (related.join(g.n("Issue").select("id", "title", "ts"), "id").select("root", "id", "title", "ts"), "issue", issues),
    ]
    order = Window.partitionBy("root").orderBy(F.desc("ts"), "id")
    ranked = [df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("root", F.lit(kind).alias("kind"), F.col("rank").cast("long").alias("rank"), "id", "title", "ts") for df, kind, most in some]
    return ranked[0].unionAll(ranked[1]).unionAll(ranked[2])


def counts(g: Graph) -> DataFrame:
    """(entity, commits, pulls, issues): how many distinct ones stand behind the file of each function, class and file."""
    found = changes(g).select("file", "commit").distinct()
    requests = found.join(g.e("CONTAINS", src="PullRequest").select(F.col("src").alias("pr"), F.col("dst").alias("commit")), "commit").select("file", "pr").distinct()
    related = requests.join(g.e("RELATED_TO").select(F.col("src").alias("issue"), F.col("dst").alias("pr")), "pr")
    sums = found.groupBy("file").agg(F.count("*").alias("commits")).join(requests.groupBy("file").agg(F.count("*").alias("pulls")), "file", "left")
    sums = sums.join(related.groupBy("file").agg(F.count_distinct("issue").alias("issues")), "file", "left")
    return entity_files(g).join(sums, "file", "left").select("entity", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("commits", "pulls", "issues")))


def top_developers(g: Graph, each: int = 5) -> DataFrame:
    """(file, dev, n, rank): the developers with the most commits of each file."""
    sums = changes(g).where("dev IS NOT NULL").groupBy("file", "dev").agg(F.count_distinct("commit").alias("n"))
    order = Window.partitionBy("file").orderBy(F.desc("n"), "dev")
    return sums.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= each)


def _page(touched: DataFrame, limit: int) -> DataFrame:
    """The newest rows, with the total and whether there are more."""
    total = touched.agg(F.count("*").alias("total"))
    page = touched.orderBy(F.desc("ts"), "commit").limit(limit)
    return page.crossJoin(F.broadcast(total)).select("commit", "ts", "title", "total", (F.col("total") > limit).alias("has_more"))  # total is one row


def file_timeline(g: Graph, file: str, limit: int) -> DataFrame:
    """The newest commits of a file, with the total and whether there are more."""
    return _page(changes(g).where(F.col("file") == file).select("commit", "ts", F.substring("message", 1, 100).alias("title")).distinct(), limit)


def load(commits: DataFrame, details: DataFrame, pulls: DataFrame, issues: DataFrame, files: DataFrame, recent: int = 30, detailed: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name, title, sha, username, message, ts) and edges (src, type, dst) from a forge's lists: commits
    (place, sha, message, date, login, author), of which the first by place are kept; details (sha, filename) of the first
    ones; pulls (number, title, created, merge_sha, head_sha); issues (number, title, created); files (path) of the
    repository. A pull request holds the kept commits that it merged or ends with; an issue belongs to the pull request of
    its number. Rows without sha or number are left out, and each node and edge comes once."""
    none = F.lit(None).cast("string")
    kept = commits.where((F.coalesce("sha", F.lit("")) != "") & (F.col("place") < recent))
    node = lambda df, label, key, name=none, title=none, sha=none, user=none, message=none, ts=none: df.select(key.alias("id"), F.lit(label).alias("label"), name.alias("name"), title.alias("title"), sha.alias("sha"), user.alias("username"), message.alias("message"), ts.try_cast("timestamp").alias("ts"))
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, a, kind, b: df.select(a.alias("src"), F.lit(kind).alias("type"), b.alias("dst"))
    people = kept.where(F.coalesce("login", F.lit("")) != "").groupBy("login").agg(F.min_by("author", "place").alias("author"))
    asked, raised = pulls.where("number > 0"), issues.where("number > 0")
    nodes = [
        node(kept, "Commit", named("commit", "sha"), sha=F.col("sha"), message=F.coalesce("message", F.lit("")), ts=F.col("date")),
        node(people, "Developer", named("dev", "login"), name=F.coalesce("author", "login"), user=F.col("login")),
        node(asked, "PullRequest", named("pr", "number"), title=F.coalesce("title", F.lit("")), ts=F.col("created")),
        node(raised, "Issue", named("issue", "number"), title=F.coalesce("title", F.lit("")), ts=F.col("created")),
    ]
    shas = kept.select("sha").distinct()
    modified = details.join(kept.where(F.col("place") < detailed).select("sha").distinct(), "sha").join(files.select(F.col("path").alias("filename")).distinct(), "filename")
    merged = asked.select("number", F.explode(F.array("merge_sha", "head_sha")).alias("sha")).join(shas, "sha")
    edges = [
        edge(kept.where(F.coalesce("login", F.lit("")) != ""), named("commit", "sha"), "AUTHORED_BY", named("dev", "login")),
        edge(modified, named("commit", "sha"), "MODIFIES", named("file", "filename")),
        edge(merged, named("pr", "number"), "CONTAINS", named("commit", "sha")),
        edge(raised.join(asked.select("number").distinct(), "number"), named("issue", "number"), "RELATED_TO", named("pr", "number")),
    ]
    return reduce(DataFrame.unionAll, nodes).dropDuplicates(["id"]), reduce(DataFrame.unionAll, edges).distinct()


def repo_files(g: Graph, max_hops: int = 4) -> DataFrame:
    return g.contained(max_hops).where(F.col("label") == "File").select(F.col("root").alias("repo"), F.col("id").alias("file"))


def repo_activity(g: Graph, since: str | None = None) -> DataFrame:
    """(repo, commits, pulls, issues) since a time, each counted once; without a time all count."""
    late = (lambda c: F.col(c) >= F.lit(since).cast("timestamp")) if since else (lambda c: F.lit(True))
    touched = repo_files(g).join(changes(g), "file").select("repo", "commit", "ts").distinct()
    pulls = g.e("CONTAINS", src="PullRequest").select(F.col("dst").alias("commit"), F.col("src").alias("pr"))
    pulls = touched.join(pulls, "commit").join(g.n("PullRequest").select(F.col("id").alias("pr"), F.col("ts").alias("pr_ts")), "pr")
    issues = g.e("RELATED_TO").select(F.col("dst").alias("pr"), F.col("src").alias("issue")).join(g.n("Issue").select(F.col("id").alias("issue"), F.col("ts").alias("i_ts")), "issue")
    issues = pulls.join(issues, "pr").where(late("i_ts")).groupBy("repo").agg(F.count_distinct("issue").alias("issues"))
    pulls = pulls.where(late("pr_ts")).groupBy("repo").agg(F.count_distinct("pr").alias("pulls"))
    commits = touched.where(late("ts")).groupBy("repo").agg(F.count("*").alias("commits"))
    out = g.n("Repository").select(F.col("id").alias("repo")).join(commits, "repo", "left").join(pulls, "repo", "left").join(issues, "repo", "left")
    return out.select("repo", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("commits", "pulls", "issues")))


def contributors(g: Graph, limit: int | None = None) -> DataFrame:
    """(dev, commits, last): distinct commits of each author and the last one's time."""
    commits = g.n("Commit").select(F.col("id").alias("src"), "ts")
    out = g.e("AUTHORED_BY", src="Commit").join(commits, "src").groupBy(F.col("dst").alias("dev")).agg(F.count_distinct("src").alias("commits"), F.max("ts").alias("last"))
    return out.orderBy(F.desc("commits"), "dev").limit(limit) if limit else out


def frequency(g: Graph, as_of: str) -> DataFrame:
    """(file, total, last, d7, d30, d90): commits of each file, and those within so many days before as_of."""
    at = F.lit(as_of).cast("timestamp")
    within = lambda n: F.count_if(F.col("ts") >= at - F.make_interval(days=F.lit(n))).alias(f"d{n}")
    return changes(g).select("file", "commit", "ts").distinct().groupBy("file").agg(F.count("*").alias("total"), F.max("ts").alias("last"), within(7), within(30), within(90))


def heatmap(g: Graph, limit: int) -> DataFrame:
    """The most changed files, and their share of the greatest number of commits."""
    top = g.e("MODIFIES").groupBy(F.col("dst").alias("file")).agg(F.count_distinct("src").alias("n")).orderBy(F.desc("n"), "file").limit(limit)
    return top.select("file", "n", F.coalesce(F.try_divide(F.col("n"), F.max("n").over(Window.partitionBy())), F.lit(0.0)).alias("intensity"))


def timeline(g: Graph, repo: str, limit: int) -> DataFrame:
    """The newest commits of a repository's files, with the total and whether there are more."""
    touched = repo_files(g, 5).where(F.col("repo") == repo).join(changes(g), "file").select("commit", "ts", F.substring("message", 1, 100).alias("title")).distinct()
    return _page(touched, limit)


def newest_change(g: Graph) -> DataFrame:
    """(file, commit, ts, pr, issue, dev): why a file last changed; of several pull requests or issues the first id."""
    last = changes(g).groupBy("file").agg(F.max(F.struct("ts", "commit")).alias("m")).select("file", "m.commit", "m.ts")
    author = g.e("AUTHORED_BY", src="Commit").groupBy(F.col("src").alias("commit")).agg(F.min("dst").alias("dev"))
    pr = g.e("CONTAINS", src="PullRequest").groupBy(F.col("dst").alias("commit")).agg(F.min("src").alias("pr"))
    issue = g.e("RELATED_TO").groupBy(F.col("dst").alias("pr")).agg(F.min("src").alias("issue"))
    return last.join(author, "commit", "left").join(pr, "commit", "left").join(issue, "pr", "left").select("file", "commit", "ts", "pr", "issue", "dev")


def activity_feed(g: Graph, limit: int) -> DataFrame:
    """Commits, pull requests and issues in one list, newest first."""
    feed = [g.n("Commit").select("id", F.lit("commit").alias("kind"), F.substring("sha", 1, 7).alias("title"), "ts"), g.n("PullRequest").select("id", F.lit("pull").alias("kind"), "title", "ts"), g.n("Issue").select("id", F.lit("issue").alias("kind"), "title", "ts")]
    return feed[0].unionByName(feed[1]).unionByName(feed[2]).orderBy(F.desc("ts"), "id").limit(limit)

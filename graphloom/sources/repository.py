"""Sources of repositories: directories of files, forge payloads, and the text of git commands."""

from __future__ import annotations

import os
import re
import subprocess
import tarfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import IGNORED, category, extension, language

MAX_FILE, MAX_PARSED = 5 << 20, 500_000


#: Schemas of a forge's lists.
COMMITS = "sha string, commit struct<message: string, author: struct<name: string, date: string>>, author struct<login: string>"
COMMIT_FILES = "sha string, files array<struct<filename: string, status: string, additions: int, deletions: int>>"
PULLS = "number long, title string, state string, created_at string, merged_at string, merge_commit_sha string, head struct<sha: string>"
ISSUES = "number long, title string, state string, created_at string"
REPOSITORIES = "id long, name string, full_name string, default_branch string, created_at string, updated_at string"


def source(where: str, scratch: str) -> str:
    """A directory of files for a place: a local directory as it is, a tarball unpacked below scratch (its first directory is
    the root), or a git URL cloned there. Links and paths that lead out of a tarball are refused."""
    if where.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(where) as tar:
            tar.extractall(scratch, filter="data")
        inner = sorted(x for x in os.listdir(scratch) if os.path.isdir(os.path.join(scratch, x)))
        return os.path.join(scratch, inner[0]) if inner else scratch
    if re.match(r"(https://|file://).*", where) and (where.endswith(".git") or "://" in where and not where.startswith("file:/")):
        subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", where, scratch], check=True, capture_output=True, timeout=600)
        return scratch
    return where


def files(spark: SparkSession, root: str, most: int | None = None, max_file: int = MAX_FILE) -> DataFrame:
    """(path, extension, language, category, size, hash, content) of all files below a directory, as far as they are not
    empty, too large, hidden or in an ignored directory, the first ones by path if only so many are asked for; content is
    null for binaries and for files too large to parse."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), rf"^\Q{'/' + base.lstrip('/')}\E/", "")
    raw = raw.withColumn("path", path).where((F.col("length") > 0) & (F.col("length") <= max_file)).where(~F.col("path").rlike(rf"(^|/)({'|'.join(x.replace('.', '[.]') for x in IGNORED)}|\.[^/]+)/"))
    if most is not None:
        raw = raw.join(raw.select("path").orderBy("path").limit(most), "path", "left_semi")
    text = F.when((F.col("length") <= MAX_PARSED) & (category(F.col("path")) != "BINARY"), F.decode("content", "UTF-8"))
    return raw.select("path", extension(F.col("path")).alias("extension"), language(F.col("path")).alias("language"), category(F.col("path")).alias("category"), F.col("length").alias("size"), content_hash(F.col("content"), F.col("length"), F.col("modificationTime")).alias("hash"), text.alias("content"))


def content_hash(content: Column, size: Column, modified: Column) -> Column:
    """SHA-256 of the content; of size and time for files that are not parsed; error: for a content that could not be read."""
    return F.when(content.isNull() & (size <= MAX_PARSED), F.lit("error:")).when(size <= MAX_PARSED, F.sha2(content, 256)).otherwise(F.sha2(F.concat_ws(":", size.cast("string"), F.unix_millis(modified).cast("string")), 256))


def payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Captured JSON pages of a forge, one array or object a file, with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def git(directory: str, *arguments: str, timeout: int = 30) -> str:
    """The text of a git command, run by the driver."""
    return subprocess.run(["git", "-C", directory, *arguments], capture_output=True, text=True, check=True, timeout=timeout).stdout


def log(directory: str, revisions: str = "HEAD", most: int = 1000) -> list[tuple[str, str, str, str]]:
    """(sha, author, date, subject) of the newest commits of some revisions."""
    text = git(directory, "log", f"--max-count={most}", "--format=%H%x1f%an%x1f%aI%x1f%s%x1e", revisions, "--")
    return [tuple(x.strip("\n").split("\x1f")) for x in text.split("\x1e") if x.strip()]


def behind(directory: str, old: str, new: str = "HEAD") -> int:
    """How many commits lead from one revision to another."""
    return int(git(directory, "rev-list", "--count", f"{old}..{new}", "--"))


def change_set(spark: SparkSession, name_status: str, numstat: str = "") -> DataFrame:
    """(path, old_path, status, added, deleted) of the text of diff --name-status and --numstat; binaries count 0."""
    lines = lambda text: spark.createDataFrame([(x,) for x in text.splitlines() if x.strip()], "line string").select(F.split("line", "\t").alias("p"))
    code = F.substring(F.get("p", F.lit(0)), 1, 1)
    renamed = code.isin("R", "C")
    status = F.when(code == "A", "ADDED").when(code == "M", "MODIFIED").when(code == "D", "DELETED").when(code == "R", "RENAMED").when(code == "C", "ADDED").otherwise("MODIFIED")
    changed = lines(name_status).select(F.when(renamed, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1))).alias("path"), F.when(code == "R", F.get("p", F.lit(1))).alias("old_path"), status.alias("status"))
    count = lambda k: F.coalesce(F.get("p", F.lit(k)).try_cast("int"), F.lit(0))
    moved = F.regexp_replace(F.regexp_replace(F.get("p", F.lit(2)), r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    sums = lines(numstat).select(F.regexp_replace(moved, "//+", "/").alias("path"), count(0).alias("added"), count(1).alias("deleted"))
    return changed.join(sums, "path", "left").select("path", "old_path", "status", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("deleted", F.lit(0)).alias("deleted"))

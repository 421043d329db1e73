"""Quality rules (native): cross-document line frequency beside per-document counts.

Lines are normalised (lower case, white space runs as one space, trimmed) and hashed. For each host (the column
``source``) the operator counts the distinct documents that hold a line; exact copies of a text count once. A line
above the host's limit, ``max(MIN_DOCS, GROWTH * sqrt(the host's distinct texts))``, is template text. It is removed, and
a document that keeps less than KEEP of its words is depleted and rejected. The limit is a number of documents that grows
slowly, so that a passage cannot hide in a large host, while the lines that a group of near copies shares, which is part
of its host, do not condemn a small host's originals.

Lines are counted by (host, line) with sums before the shuffle; the words that a text loses are summed by (host, text).
Neither a host nor a line is gathered anywhere, and both joins broadcast only what has been measured to be small.

Defined results: a null or empty text has no words and fails; null hosts form one host; repeated rows are judged alike,
each giving a row; extra columns stay; a column named as the result column is replaced; an empty table gives no rows;
very long texts are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, maybe_broadcast, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
MIN_DOCS, GROWTH, KEEP = 20, 2.0, 0.30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def normal_lines(text: Column) -> Column:
    """The hash of each normalised line with a word, and its number of words."""
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
    lines = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")
    # between the words of a normalised line stands one space
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))


def texts_of(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, text_hash, lines) of the distinct texts of each host."""
    out = df.select(F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("text_hash"), normal_lines(F.col(text)).alias("lines"))
    return out.dropDuplicates(["host", "text_hash"])


def frequent_lines(texts: DataFrame, min_docs: int = MIN_DOCS, growth: float = GROWTH) -> DataFrame:
    """(host, line): the lines above their host's limit."""
    sizes = texts.groupBy("host").agg(F.count("*").alias("texts"))
    counts = texts.select("host", F.explode(F.array_distinct("lines.line")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    limit = F.greatest(F.lit(float(min_docs)), F.lit(growth) * F.sqrt("texts"))
    return counts.join(sizes, counts["host"].eqNullSafe(sizes["host"])).where(F.col("docs") > limit).select(counts["host"], "line")


def removed_words(df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, growth: float = GROWTH) -> DataFrame:
    """(host, text_hash, removed): the words that a text has in lines above its host's limit, where it has some."""
    texts = written(texts_of(df, text, host), "lines")
    frequent = written(frequent_lines(texts, min_docs, growth), "frequent")
    lines = texts.select("host", "text_hash", F.explode("lines").alias("l")).select("host", "text_hash", "l.line", "l.n")
    few = maybe_broadcast(frequent.select(F.col("host").alias("h"), F.col("line").alias("f")), 64)
    hit = lines.join(few, (F.col("line") == F.col("f")) & F.col("host").eqNullSafe(F.col("h")), "left_semi")
    out = written(hit.groupBy("host", "text_hash").agg(F.sum("n").cast("long").alias("removed")), "removed")
    discard(texts, frequent)
    return out


def judge(df: DataFrame, text: str = "text", host: str = "source", into: str = "quality", min_docs: int = MIN_DOCS, growth: float = GROWTH, keep: float = KEEP) -> DataFrame:
    """df with a struct column: the counts, base_failed, removed_words and kept."""
    kept_columns = [c for c in df.columns if c != into]
    lost = removed_words(df, text, host, min_docs, growth)
    lost = maybe_broadcast(lost.select(F.col("host").alias("__host"), F.col("text_hash").alias("__text_hash"), F.col("removed").alias("__removed")), 64)

    t = F.coalesce(F.col(text), F.lit(""))
    step = df.withColumn("__words", words_of(F.col(text)))
    step = step.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get("__hashes", i + F.lit(k))
    last = F.greatest(F.size("__hashes") - (WINDOW - 1), F.lit(0))
    step = step.withColumn("__grams", F.transform(F.slice("__hashes", F.lit(1), last), lambda h, i: F.xxhash64(h, *(at(i, k) for k in range(1, WINDOW)))))
    # positions are looked for only where some window occurs twice
    repeats = F.size(F.array_distinct("__grams")) < F.size("__grams")
    pairs = F.array_sort(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    step = step.withColumn("__sorted", F.when(repeats, pairs))
    twin = lambda s, i, k: F.coalesce(F.get("__sorted", i + F.lit(k))["g"] == s["g"], F.lit(False))
    doubled = F.filter("__sorted", lambda s, i: twin(s, i, 1) | ((i > 0) & twin(s, F.greatest(i, F.lit(1)), -1)))
    step = step.withColumn("__at", F.array_sort(F.transform(doubled, lambda s: s["i"])))
    gaps = F.transform("__at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", j + F.lit(1)) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))

    step = step.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.join(lost, F.col(host).cast("string").eqNullSafe(F.col("__host")) & (F.xxhash64(text) == F.col("__text_hash")), "left")
    counted = step.select(
        *(F.col(f"`{c}`") for c in kept_columns),
        F.size("__words").cast("long").alias("__n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("__word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("__n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        covered.alias("__n_repeat_words"),
        F.coalesce("__removed", F.lit(0)).cast("long").alias("__removed_words"),
        F.monotonically_increasing_id().alias("__once"),  # keeps filters on the verdict above the counts, made once
    )
    n = F.col("__n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("__n_repeat_words") > REPEAT_PERCENT * n)
    depleted = (n - F.col("__removed_words")) < F.lit(keep) * n
    fields = [F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words")]
    verdict = F.struct(*fields, failed.alias("base_failed"), (~failed & ~depleted & (F.col("__once") >= 0)).alias("kept"))
    return counted.select(*(F.col(f"`{c}`") for c in kept_columns), verdict.alias(into))


def keep_good(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of df that pass, with df's columns."""
    return judge(df, text, host, "__quality").where(F.col("__quality.kept")).drop("__quality")


def report(df: DataFrame, text: str = "text", host: str = "source", row_id: str = "doc_id") -> DataFrame:
    """One row a document: its id and the result's fields."""
    return judge(df.select(row_id, text, host), text, host, "__quality").select(row_id, "__quality.*")

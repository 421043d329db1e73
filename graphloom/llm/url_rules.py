"""URL filter (native): host and path rules, and association rules mined from labelled URLs.

A URL's tokens are its host and parent domains, the host's first label, its path segments without digits, and its query
keys. A rule is a set of at most SIZE tokens that occur with the label ``block`` in LEAST or more of the labelled URLs, at
any number of labels, and in at least a part CONFIDENCE of all URLs that have them; a rule is pruned if one on fewer of its
tokens is as confident. An inverted index (token to rules) matches rules to URLs: a rule holds where as many of its tokens
are found as it has items. A URL is blocked by the longest fitting host and path rule, or without one if an association
rule holds.

Every count is over all tokens of all labelled URLs. What is mined is smaller without any loss: tokens of fewer than LEAST
blocked URLs are in no rule; tokens that stand in the very same labelled URLs (a host and its parents, the segments of one
path) are one item, which is found where any of them is; an item that is confident enough by itself is a rule, and holds
wherever a longer one with it would, so only other items are combined. FP-growth finds the combinations. A set of k items
has 2 ** k subsets, all of which it lists, so where a URL has more than ITEMS of them left, sets are grown by one item at a
time up to SIZE instead, from the frequent ones that are no rule yet; both ways give the same rules.

Defined results: a null URL, or one without ``://``, has an empty host and path and no tokens; labels that are null are
left out; without labelled URLs no rule is mined; repeated rows each give a row; an empty table gives none; very long URLs
are matched whole; other columns stay, and one named as the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, written
from .licenses import LOWER, UPPER

LEAST, CONFIDENCE = 10, 0.5
#: Items of a rule, and items of a URL whose subsets FP-growth lists.
SIZE, ITEMS = 4, 14
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class HostRule:
    """verdict for host and all its subdomains where the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = [HostRule("block", "com", "/en/"), HostRule("allow", "example.com", "/en/7"), HostRule("allow", "net", "/de/"), HostRule("block", "example.net", "/de/8"), HostRule("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct: domain:name for the host and each parent domain, host:label for its first, path:segment, query:key."""
    host, path = host_of(url), path_of(url)
    labels = F.array_remove(F.split(host, r"\."), "")
    parents = F.transform(labels, lambda _, i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.array_remove(F.split(F.translate(path, UPPER, LOWER), "/"), "")
    segments = F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.array_remove(F.split(query, "&"), ""), lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, r"(?s)^([^=]*)", 1)))
    named = F.transform(F.slice(labels, 1, 1), lambda x: F.concat(F.lit("host:"), x))
    return F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("://")), F.array_distinct(F.concat(named, parents, segments, keys))).otherwise(F.array().cast("array<string>"))


def items_of(labelled: DataFrame, url: str = "url", block: str = "block", least: int = LEAST, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(row, block, items): of each labelled URL the items that are combined, in order; and (token, item, part, n): the tokens
    of each item, the part of its URLs that is blocked, and how many it has. See the head of this module."""
    known = labelled.where(F.col(block).isNotNull()).select(F.col(block).alias("block"), tokens_of(F.col(url)).alias("tokens"))
    known = written(known.withColumn("row", F.monotonically_increasing_id()), "labelled")
    rows = known.select("row", "block", F.explode("tokens").alias("token"))
    # two sums of hashed rows and the number of rows name the set of a token's URLs
    name = F.struct(F.count("*").alias("n"), *(F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)))
    sums = rows.groupBy("token").agg(name.alias("set"), F.count_if("block").alias("blocked")).where(F.col("blocked") >= least)
    sums = written(sums.select("token", F.xxhash64("set").alias("key"), "set.n", (F.col("blocked") / F.col("set.n")).alias("part")), "tokens")
    first = sums.groupBy("key").agg(F.min("token").alias("item"))
    classes = written(sums.join(first, "key").select("token", "item", "part", "n"), "items")
    one = rows.join(classes.where((F.col("token") == F.col("item")) & (F.col("part") < confidence)), "token")
    some = one.groupBy("row").agg(F.first("block").alias("block"), F.array_sort(F.collect_list("item")).alias("items"))  # at most a URL's tokens
    return written(some, "combined"), classes


def mined(some: DataFrame, least: int, confidence: float, size: int) -> DataFrame:
    """(tokens, confidence): the rules of two items or more, by FP-growth over all subsets of a URL's items."""
    label = F.when(F.col("block"), F.lit("label:block")).otherwise(F.lit("label:allow"))
    items = written(some.select(F.array_append("items", label).alias("items")), "items")
    # a little less, as FP-growth rounds the count up
    support = min(1.0, max(0.0, least - 0.5) / max(1, items.count()))
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(items).freqItemsets
    sets = written(sets.select(F.filter("items", lambda x: ~x.startswith("label:")).alias("tokens"), F.array_contains("items", "label:block").alias("block"), F.exists("items", lambda x: x.startswith("label:")).alias("label"), "freq"), "sets")
    sets = sets.where(F.size("tokens").between(2, size)).withColumn("tokens", F.array_sort("tokens"))
    both = sets.where("block").select("tokens", F.col("freq").alias("hits")).join(sets.where("NOT label").select("tokens", "freq"), "tokens")
    part = F.col("hits") / F.col("freq")
    return both.where((F.col("hits") >= least) & (part >= confidence)).select("tokens", part.alias("confidence"))


def grown(some: DataFrame, least: int, confidence: float, size: int) -> DataFrame:
    """The same rules, sets one item larger at a time: each URL's frequent sets that are no rule, with each later item."""
    items = some.select("row", "block", F.explode("items").alias("item"))
    sets = items.select("row", "block", F.array("item").alias("tokens"))
    found: list[DataFrame] = []
    for _ in range(2, size + 1):
        larger = sets.join(items.select("row", "item"), "row").where(F.col("item") > F.element_at("tokens", -1))
        larger = written(larger.select("row", "block", F.array_append("tokens", F.col("item")).alias("tokens")), "larger")
        sums = larger.groupBy("tokens").agg(F.count_if("block").alias("hits"), F.count("*").alias("n")).where(F.col("hits") >= least)
        sums = written(sums.select("tokens", (F.col("hits") / F.col("n")).alias("confidence")), "sums")
        found.append(sums.where(F.col("confidence") >= confidence))
        sets = larger.join(sums.where(F.col("confidence") < confidence).select("tokens"), "tokens", "left_semi")
    return reduce(DataFrame.unionAll, found)


def mine(labelled: DataFrame, url: str = "url", block: str = "block", least: int = LEAST, confidence: float = CONFIDENCE, size: int = SIZE, items: int = ITEMS) -> DataFrame:
    """(rule, token, item, size): the kept rules, a row for each token of each item. labelled: URLs and a boolean column
    block."""
    some, classes = items_of(labelled, url, block, least, confidence)
    single = classes.where((F.col("token") == F.col("item")) & (F.col("part") >= confidence)).select(F.array("item").alias("tokens"), F.col("part").alias("confidence"))
    many = mined if (some.agg(F.max(F.size("items"))).first()[0] or 0) <= items else grown
    rules = single.unionAll(many(some, least, confidence, size)) if size > 1 else single
    rules = written(rules.withColumn("rule", F.xxhash64("tokens")), "rules")
    # a rule on fewer tokens that is as confident makes a longer one needless: each asks for its own subsets
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
    parts = F.sequence(F.lit(1), bit(F.size("tokens")) - 2)
    subset = F.filter("tokens", lambda _, i: F.col("part").bitwiseAND(bit(i)) != 0)
    asked = rules.where("size(tokens) > 1").select("rule", "tokens", "confidence", F.explode(parts).alias("part")).select("rule", "confidence", F.xxhash64(subset).alias("short"))
    short = rules.select(F.col("rule").alias("short"), F.col("confidence").alias("c"))
    needless = asked.join(short, "short").where(F.col("c") >= F.col("confidence")).select("rule").distinct()
    kept = rules.join(needless, "rule", "left_anti").select("rule", F.explode("tokens").alias("item"), F.size("tokens").alias("size"))
    index = kept.join(classes, "item")
    # each token of a single item is a rule of its own
    return written(index.select(F.when(F.col("size") == 1, F.xxhash64("token")).otherwise(F.col("rule")).alias("rule"), "token", "item", "size"), "index")


def matched(urls: DataFrame, index: DataFrame, url: str = "url") -> DataFrame:
    """The distinct URLs that a rule of the index holds for."""
    tokens = urls.select(F.col(url).alias("__url")).distinct().select("__url", F.explode(tokens_of(F.col("__url"))).alias("token"))
    hits = tokens.join(maybe_broadcast(index, 64), "token").groupBy("__url", "rule", "size").agg(F.count_distinct("item").alias("n"))
    return hits.where("n = size").select("__url").distinct()


def host_rule(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """The longest rule that fits, as a struct; null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, labelled: DataFrame, rules: list[HostRule] = RULES, url: str = "url", into: str = "filter") -> DataFrame:
    """pages with a struct column: host, path, rule and verdict."""
    blocked = matched(pages, mine(labelled), url).withColumn("__blocked", F.lit(True))
    step = pages.withColumn("__host", host_of(F.col(url))).withColumn("__path", path_of(F.col(url)))
    step = step.withColumn("__rule", host_rule(F.col("__host"), F.col("__path"), rules)).join(blocked, F.col(url) == F.col("__url"), "left")
    own = F.when(F.col("__blocked"), F.lit("block")).otherwise(F.lit("allow"))
    result = F.struct(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", own).alias("verdict"))
    return step.select(*(F.col(f"`{c}`") for c in pages.columns if c != into), result.alias(into))

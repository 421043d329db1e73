"""Search of nodes by a part of their name, from an index of grams instead of a scan of all names.

The index has a row for each node and each pair and triple of characters in its search label, case aside, in folders by the
gram's hash and sorted by gram; a gram of very many nodes is cut into several files by the nodes' hashes, and no list of nodes
is ever gathered. A search reads the folders of its own grams alone (triples; pairs for two characters), keeps nodes that have
all of them, and looks these up among the labels, where the whole text is compared. One character says too little and
scans the labels.

Defined results: as deps.search: a null label is empty; the empty text is in every label; repeated nodes each give a row;
no nodes give no rows; characters are code points, and any may be searched for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import human_label, search_label
from ..scratch import shared_dir

#: Folders of grams and of labels, and files that a folder of grams may be cut into.
BUCKETS, PIECES = 64, 4


def grams(text: Column, size: int) -> Column:
    """The distinct runs of so many characters of a text."""
    starts = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(size))))


def _bucket(c: str | Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


class Index:
    """An index of nodes below a path that Spark's file systems reach; without a path, in the scratch folder."""

    def __init__(self, nodes: DataFrame, path: str | None = None):
        self.spark = nodes.sparkSession
        self.path = (path or f"{shared_dir(self.spark)}/graphloom-grams-{uuid.uuid4().hex}").rstrip("/")
        named = nodes.select("id", "label", F.lower(search_label()).alias("said"), human_label().alias("title")).withColumn("home", _bucket("id"))
        named.repartition("home").write.partitionBy("home").parquet(f"{self.path}/labels")
        # repeated nodes repeat their grams, which a search counts once: no table of all grams is held to tell them apart
        rows = named.select("id", "home", F.explode(F.array_union(grams(F.col("said"), 2), grams(F.col("said"), 3))).alias("gram")).withColumn("bucket", _bucket("gram"))
        cut = F.pmod(F.xxhash64("id"), F.lit(PIECES))
        rows.repartition("bucket", cut).sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{self.path}/grams")

    def _parts(self, text: str) -> list[str]:
        size = min(3, len(text))
        return sorted({text[k : k + size] for k in range(len(text) - size + 1)}) if size > 1 else []

    def postings(self, text: str) -> DataFrame:
        """(gram, id, home): the rows of a text's grams, from their folders alone."""
        parts = self._parts(text)
        found = self.spark.range(1).select(*(_bucket(F.lit(p)).alias(str(k)) for k, p in enumerate(parts))).first() if parts else []
        return self.spark.read.schema("id string, home int, gram string, bucket int").parquet(f"{self.path}/grams").where(F.col("bucket").isin(sorted(set(found))) & F.col("gram").isin(parts)).select("gram", "id", "home")

    def search(self, text: str, labels: list[str], limit: int) -> DataFrame:
        """(id, label, title): nodes of some labels whose search label holds the text, case aside, by title and id."""
        text = text.lower()
        known = self.spark.read.schema("id string, label string, said string, title string, home int").parquet(f"{self.path}/labels").where(F.col("label").isin(*labels))
        parts = self._parts(text)
        if parts:
            hits = self.postings(text)
            if len(parts) > 1:
                # a bit for each of the text's grams; beyond 64 characters of it the others are left to the comparison
                bit = F.coalesce(*(F.when(F.col("gram") == p, F.lit(1 << k)) for k, p in enumerate(parts[:60])), F.lit(0)).cast("long")
                hits = hits.groupBy("id", "home").agg(F.bit_or(bit).alias("n")).where(F.col("n") == (1 << min(60, len(parts))) - 1)
            known = known.join(hits.select("id", "home"), ["home", "id"], "left_semi")
        return known.where(F.contains("said", F.lit(text))).select("id", "label", "title").orderBy("title", "id").limit(limit)

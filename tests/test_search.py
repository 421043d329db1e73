"""The index of grams against a scan."""

import random
import re

from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import deps
from graphloom.operators.search import Index, grams

NODE = "id string, label string, name string, title string, path string, sha string, username string, message string"


def test_grams(spark):
    rows = spark.createDataFrame([("abcab",), ("a",), ("",), (None,), ("é😀x",)], "t string").select(grams(F.col("t"), 2).alias("a"), grams(F.col("t"), 3).alias("b")).collect()
    assert [sorted(r["a"]) for r in rows] == [["ab", "bc", "ca"], [], [], [], ["é😀", "😀x"]] and rows[0]["b"] == ["abc", "bca", "cab"]


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(2)
    rows = [(f"n{k}", rng.choice(["File", "Class"]), "".join(rng.choices("aAbÉé😀%_.", k=rng.randint(0, 9))) if k % 7 else None, "Title aB" if k % 14 == 0 else None, None, None, None, None) for k in range(200)]
    rows += [rows[3], ("other", "Test", "abab", None, None, None, None, None)]
    nodes = spark.createDataFrame(rows, NODE)
    g = Graph({"": lambda: nodes}, {})
    index = Index(nodes)
    for text in ["", "a", "AB", "aba", "éa", "😀", "b.%", "_é", "ababab", "title", "zzz", "e A"]:
        want = deps.search(g, text, ["File", "Class"], 1000).collect()
        assert sorted(map(tuple, index.search(text, ["File", "Class"], 1000).collect())) == sorted(map(tuple, want)), text
    assert len(index.search("a", ["File"], 3).collect()) == 3
    # only the folders of the text's grams are read
    folders = {re.search(r"bucket=(\d+)", r[0])[1] for r in index.postings("abab").select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(folders) <= 2 and "PartitionFilters: [bucket" in index.postings("abab")._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket#", "bucket#")
    none = Index(nodes.limit(0))
    assert none.search("ab", ["File"], 5).count() == none.search("", ["File"], 5).count() == 0


def test_index_is_built_without_a_table_of_all_grams(spark, monkeypatch):
    """No aggregate of the exploded grams, which were held by the task that made them; repeated nodes are found as before."""
    from pyspark.sql import DataFrame

    made = []
    monkeypatch.setattr(DataFrame, "distinct", lambda self: made.append(self) or self.dropDuplicates())
    nodes = spark.createDataFrame([("n1", "File", "abcabc", None, None, None, None, None)] * 3 + [("n1", "File", "xyz", None, None, None, None, None), ("n2", "File", "abz" * 40, None, None, None, None, None)], NODE)
    index = Index(nodes)
    assert not made
    assert [r["id"] for r in index.search("bca", ["File"], 9).collect()] == ["n1"] * 3
    assert [r["id"] for r in index.search("abcabc", ["File"], 9).collect()] == ["n1"] * 3
    assert [r["id"] for r in index.search("abz" * 39, ["File"], 9).collect()] == ["n2"]
    assert index.search("abcxyz", ["File"], 9).count() == 0

"""From documents to token digests: quality rules, near-duplicate removal, decontamination, BPE round trip.

Each stage works on what its predecessor kept; all but the last return the columns of documents, others that the table
has included. Stages know a row by its id and text, never by its place, so a lost executor changes nothing.

Defined results: a null or empty text has no words and goes in the first stage; null ids, languages and hosts are kept (null
hosts are one host); of equal or similar documents the least id stays, null last, and of repeated rows one; very long texts
are judged and encoded whole; empty tables give empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontaminate, jaccard, quality_rules
from graphloom.llm.common import small_batches, table, written
from graphloom.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: too few words, too many repeated ones, or little but template lines."""
    small_batches(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles with a similarity of 0.8 or more, groups by reachability."""
    small_batches(spark)
    return jaccard.one_of_each(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark text go: a hit, and 5 % or more of the words hit. Null and empty items hit nothing."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, special strings inside texts included: doc_id, n_tokens and digests of ids and text."""
    small_batches(spark)
    return bpe.digests(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("jaccard_near_duplicates", near_duplicates), ("decontamination", decontamination), ("bpe_round_trip", tokens)]

#: BPE and whole-set similarities are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

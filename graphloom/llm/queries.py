"""The queries of this subpackage: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, decontaminate, hamerly, hmm, jaccard, licenses, packing, page_text, quality_rules, token_counts, url_rules, warc
from .common import table
from .sql import ORACLES

#: WARC-Date of the records made from the table of pages, which has no dates.
CRAWLED = "2024-01-01T00:00:00Z"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the toxicity label of its id."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", (F.col("toxic") == 1).alias("block"))
    return url_rules.judge(pages, labelled, into="__filter").select("page_id", "__filter.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages"), CRAWLED), ("page_id",))
    return made.withColumn("block_sha256", F.sha2("block", 256)).drop("block")


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_page_text, op2_token_counts, op3_licence_scan, op4_quality_rules, op5_hmm_scores, op6_bpe_round_trip, op7_url_rules, op8_decontaminate, op9_warc_derivatives, op10_jaccard_components, op11_best_fit_packing, op12_cross_tokenizer_alignment, op13_hamerly_clusters)
}
__all__ = ["ORACLES", "QUERIES"]

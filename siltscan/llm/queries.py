"""The subpackage's queries, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltscan.llm import bpe, cells, html, linecrf, mixing, neardup, secrets, sharding, tokens, toxicity
from siltscan.llm._common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near duplicate with the document of its group that stays."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with score and terms."""
    docs = read(spark, sf_dir, "documents")
    learned = toxicity.learned_terms(docs, read(spark, sf_dir, "labels"))
    return toxicity.toxic_documents(docs, learned=learned, ordinary=toxicity.ordinary_words(docs, learned=learned))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their share of content."""
    return linecrf.kept_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest others, among all vectors, of each vector whose id is divisible by 50."""
    return cells.neighbours_of(read(spark, sf_dir, "embeddings"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(read(spark, sf_dir, "pages"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_near_duplicates,
        op3_toxicity,
        op4_bpe,
        op5_line_crf,
        op6_secret_scan,
        op7_mixing,
        op8_nearest_neighbours,
        op9_html_extraction,
        op10_hilbert_shards,
    )
}
ORACLES: dict[str, str] = {
    "op6_secret_scan": secrets.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_hilbert_shards": sharding.ORACLE,
}

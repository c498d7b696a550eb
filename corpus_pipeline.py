"""A training corpus from ``documents``: five stages of ``siltscan.llm`` in order, each over all that the one before kept.

Every stage but the last returns the columns of its input, whatever they are called; an empty table passes through all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltscan.llm import bpe, mixing, neardup, secrets, toxicity
from siltscan.llm._common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go, by the lexicon and what ``labels`` teach.

    Each row is judged by itself, whole however long. Null and empty texts, and rows with null ids, are judged like any
    other and are clean where they have no words; repeated rows go or stay together. Without labels only the lexicon counts.
    """
    learned = toxicity.learned_terms(docs, read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, learned=learned, ordinary=toxicity.ordinary_words(docs, learned=learned))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Rows with a null id, or with a null, empty or wordless text, are in no group and stay. Of rows with one id the first
    by text stays.
    """
    return neardup.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are cut out of the texts, whole however long; no row goes.

    Null and empty texts pass through. Repeated rows count once for ownership and are all redacted; null sources count as
    one owner. Secrets of an id are cut out of all its rows.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks that the sources' quotas take stay.

    Rows with one id and source are one document and stay or go together; null ids are one document a source, null sources
    one source. Null and empty texts count no tokens and belong to a block like any other. Ties go to the first source by name.
    """
    return mixing.mixed(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, a row for each row: null for a null text, none for an empty one."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]
#: Near duplicates and BPE are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result but the last written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs

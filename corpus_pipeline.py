"""A training corpus from the documents table: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import ngram_join, packing, secrets, suffix_dedup, toxicity
from spanwright.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of fifty words and more: a passage of over fifty words that stands elsewhere too is a repeat.
LONG_REPEAT = 250


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    docs = docs.select(*COLUMNS)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near duplicates (0.8 of their 5-word shingles are common) link, directly or over others, the one of the smallest doc_id stays."""
    return ngram_join.keep_one(docs.select(*COLUMNS), n=5, percent=80)


def remove_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of LONG_REPEAT bytes that start more than once go from the texts."""
    return _shaped(suffix_dedup.remove_repeats(docs, length=LONG_REPEAT, carry=("lang", "source")))


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return _shaped(secrets.mask_secrets(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("suffix_dedup", remove_long_repeats),
    ("secrets", mask_found_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the trained model, nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs

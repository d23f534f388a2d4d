"""A corpus pipeline from `documents` to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written as Parquet before the next
one reads it. All but the last return the columns of `documents`. Null and empty texts, repeated rows and empty tables
are treated as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_codec
from tallyframe.llm.common import materialise, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.7 or more."""
    return quality.keep_good(docs, quality.production_forest(spark, sf_dir, docs))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest doc_id."""
    return exact_dedup.dedup(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity of 0.8 or more ties together."""
    return ngram_join.one_of_each(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought towards equal shares: no document is left out, none of a source's is read over 1.25 times on average."""
    return mixing.mixed(docs, keep_all=True)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids: merge-dropout token ids of the whole texts, and their number."""
    return sentencepiece_codec.encode(docs).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality classifier", stage_quality),
    ("exact dedup", stage_exact_dedup),
    ("n-gram Jaccard join", stage_near_dedup),
    ("mixing sources to target weights", stage_mixing),
    ("SentencePiece encoding and decoding", stage_tokens),
]

#: The first stage's model and the last one's segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

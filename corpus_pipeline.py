"""From documents to packed training sequences: five stages over the operators of minutemill.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`docs`. run() applies them one by one, each result written as Parquet and read back for the next, so
that no stage is computed twice and a lost executor costs no more than its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from minutemill.llm import jaccard, language, packing, quality, suffix_dedup
from minutemill.llm.common import read_documents
from minutemill.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines and the documents that the rules reject go."""
    return quality.clean_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id."""
    return jaccard.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 1024."""
    return packing.pack_documents(docs, packing.production_model())


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

# Tokenisation and differencing have no SQL form; tests check columns and falling counts stage by stage and do not call run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

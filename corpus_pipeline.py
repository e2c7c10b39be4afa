"""A corpus pipeline over ``documents``: each stage is written as Parquet and read by the next.

Language ID drops texts without a language, near-dedup keeps one document of each group,
decontamination drops documents with benchmark passages, mixing repeats documents to the sources'
target weights, and the last stage writes token ids and returns their index, one row per copy.

Every stage takes the columns of ``documents`` and others beside them, whatever their names; an empty
table gives an empty one, and texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlake.llm import decontaminate, language, mixing, neardup, tokenfiles
from spanlake.llm.bytetext import small_batches
from spanlake.session import configure, cut_lineage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is found; learn from those not held out.

    Null and empty texts and texts without a letter have none; rows of null language teach nothing; repeated
    rows and equal texts fare alike.
    """
    small_batches(configure(spark))
    learn = docs.where(~language.held_out(F.col("doc_id"), 1, 3))
    return language.with_language(docs, language.fit(learn))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the least doc_id.

    Of rows that repeat an id one stays; texts without words are no duplicates of each other; rows of null id
    all stay.
    """
    small_batches(configure(spark))
    return neardup.without_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts hold none, and a null or empty item is in no document; repeated rows fare alike.
    """
    small_batches(configure(spark))
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the sources meet their target weights.

    A null source is a source of its own, the last; null and empty texts weigh nothing; rows of one id draw the
    same number, and null ids share one.
    """
    small_batches(configure(spark))
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and return their index, read from the files, one row for each row.

    Null text is an empty one and null ids come first; copies and repeated rows follow each other.
    """
    small_batches(configure(spark))
    return tokenfiles.token_file_index(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("token_files", token_stage),
]

#: The stages are models, sketches and codes that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

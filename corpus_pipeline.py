"""The corpus pipeline: quality rules, language, near-duplicates, repeated passages, packing.

Every stage works on all that the one before it kept. All but the last return the columns of
documents, and other columns that the input has. Null, empty and letterless texts go in the first two
stages (the second keeps them where no language can be learned); repeated rows are near copies of each
other, of which one stays; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from allelix.llm import language_id, near_copies, packing, quality, suffix_dedup
from allelix.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the fences of their language and source."""
    return quality.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; the model is learned from the stage's own input. Without labels all stay."""
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (5-word Jaccard similarity 0.8 or more)."""
    return near_copies.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that occur anywhere else too."""
    return suffix_dedup.keep_unrepeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in token sequences."""
    # workers of this stage live on while others begin: they hold fewer words than op3's
    return packing.pack(docs, words=400_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: Hashes of shingles, suffix order and token ids have no SQL. The operators of the stages are tested against
#: brute force or libraries, the pipeline as a whole only by what it keeps of a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

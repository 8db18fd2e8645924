"""A corpus pipeline over `documents`: quality, toxicity, near-duplicates, secrets, packing.

Each stage reads what its predecessor wrote; all but the last return the columns of `documents`.
Rejected documents leave at their stage. Secrets are masked in place, values that several owners share
(examples) stay. Packing returns one row per piece.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.llm import neardup, packing, quality, secrets, toxicity
from peakfold.llm.common import checkpoint_dir, remove, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose expected quality is good enough. Each row is judged by its own text, so of rows that
    share a doc_id one may go and one stay; null and empty texts are scored as empty ones, long ones whole;
    null keys and repeated rows go through alike; without ratings, or rows, there is nothing to reject."""
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return quality.select_good(docs, ratings)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that aren't predicted to be toxic. Odd rows as in the stage before; without toxic labels all stay."""
    return toxicity.select_clean(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words, a similarity of 0.8. Rows without words are in
    no group; of rows that repeat doc_id and text one stays; rows without a doc_id stay; ties go to the
    smallest doc_id."""
    return neardup.select_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets masked and n_chars set to the new length. Null and empty texts stay as they are,
    repeated rows are masked alike."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences; a null or empty text is its end id alone, repeated rows and null keys
    are documents of their own, a long text is cut into pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), loss=packing.LOSS, loss_mask=packing.word_mask(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("neardup", neardup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]
#: Learned scores and Unicode tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's result written to the shared folder and read again by the next.

    What a stage read is removed once the next stage's result is written; that of the last but one stays,
    as the result reads it. Other columns of documents stay up to the last stage.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs

"""A corpus pipeline over `documents`: toxic documents go, copies go, one of each near-duplicate group stays, personal
data is masked, and what is left is packed. Each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, ngram_join, packing, pii
from tessera.llm import toxicity as toxic
from tessera.llm.common import documents, new_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go, by their own row: a repeated id is judged by its text."""
    model = toxic.train(toxic.labelled_sample(docs, documents(spark, sf_dir, "labels"), "toxic", toxic.SAMPLE_ROWS))
    return toxic.keep_clean(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return exact_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 or more over 5-word shingles stays."""
    return ngram_join.representatives(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows the text."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.packing(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", dedup), ("ngram_jaccard", near_dedup), ("pii", mask_pii), ("packing", pack)]
#: Training and tokenizing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what stands between two stages is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

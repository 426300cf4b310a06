"""From raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import blocks, near_dup, packing, quality, suffix_dedup, toxicity
from sievelight.llm.queries import tokenizers_vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, as they are."""
    model = quality.learn(docs, _labels(spark, sf_dir))
    return quality.reject(docs, model, *quality.document_site())


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, as they are."""
    return toxicity.reject(docs, toxicity.learn(docs, _labels(spark, sf_dir)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates, as it is."""
    return near_dup.distinct(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has."""
    out = suffix_dedup.clean(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' ids in sequences, with the ids."""
    return packing.pack(docs, tokenizers_vocabulary(), 0, with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("packing", packed),
]

#: The stages fit models and compare suffixes: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = blocks.settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Documents to packed training sequences: STAGES, one after the other, each written and reread."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import cotraining, jaccard_join, packing, surrogates
from clickloom.llm.arrow import ship
from clickloom.llm.queries import SURROGATE_KEY
from clickloom.sources.staging import Staging

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = cotraining.score(docs, cotraining.train(docs, labels), keep=docs.columns)
    return scored.filter("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8, or that is the same word for
    word: the one with the smallest id. Which rows are copies is told by row and text, not by id: of
    different texts with one id each stays unless its own group has another. Rows without an id follow
    the same rule, behind all that have one."""
    ship(spark)
    return jaccard_join.one_of_each(docs, Staging(spark), n=5, num=80, den=100)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    ship(spark)
    replaced = surrogates.replace_pii(docs, SURROGATE_KEY, Staging(spark))
    counted = replaced.withColumn(
        "n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    )
    return counted.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their packed ids."""
    ship(spark)
    return packing.pack(docs, packing.TokenizerFile(spark, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("packing", packed),
]

# Trained classifiers, keyed surrogates and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    staging = Staging(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staging.put(stage(spark, docs, sf_dir), name)
    return docs

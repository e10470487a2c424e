"""The dealt operators as queries over the benchmark tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import (
    bpe,
    cotraining,
    exact_topk,
    jaccard_join,
    license_scan,
    mixing,
    packing,
    prefix_trie,
    spelling,
    surrogates,
    token_counts,
    url_filter,
    vantage,
)
from clickloom.llm.arrow import mapped, ship
from clickloom.sources.staging import Staging

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    @wraps(run)
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = shipped
    return shipped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_filter(table(spark, folder, "pages"), URL_RULES, Staging(spark))


@query
def op2_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = cotraining.train(documents, table(spark, folder, "labels"))
    return cotraining.score(documents, model, keep=["doc_id"])


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents")).drop("detections")


# Clean-up edits: contact data and long numbers masked, shouting and wide gaps calmed.
CLEAN_UP = [
    (r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64}){1,4}", "<mail>"),
    (r"(?<!\d)\d{5,}(?!\d)", "0"),
    (r"!{2,}", "!"),
    (r"[ \t]{2,}", " "),
]


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.Vocabulary(spark, path)
    documents = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_edited(documents, vocabulary, CLEAN_UP, keep=["doc_id"])
    return counted.drop("token_tree")


@query
def op5_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    return exact_topk.top_k(embeddings, F.col("vec_id") % 100 == 0, Staging(spark), k=10)


@query
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.Vocabulary(spark, path)
    documents = table(spark, folder, "documents").select("doc_id", "text")
    # Encoding and decoding share a pass; only what the digests need leaves it.
    steps = [bpe.encoder(vocabulary), bpe.decoder(vocabulary)]
    decoded = mapped(documents, steps, [*bpe.ENCODED, *bpe.DECODED], keep=["doc_id"])
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    file = packing.TokenizerFile(spark, public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(table(spark, folder, "documents"), file)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op8_vantage_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    return vantage.nearest(embeddings, F.col("vec_id") % 50 == 0, Staging(spark), k=5)


# Stands for the secret that a deployment would hand in.
SURROGATE_KEY = b"benchmark key of the catalogue"


@query
def op9_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace_pii(documents, SURROGATE_KEY, Staging(spark))


@query
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"), Staging(spark), n=3, num=90, den=100)


@query
def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), Staging(spark)).taken().drop("source")


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"), Staging(spark))


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"), Staging(spark))

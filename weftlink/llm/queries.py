"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import exact_dedup as dedup
from . import licenses, mixing, ngram_join, packing, quality, repeats, sharding, spelling, token_counts, vectors, warc, whitening
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A shard's bytes; small enough that a few MB of documents make several shards.
SHARD_BYTES = 1 << 20


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(configure(spark), sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = configure(spark)
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(configure(spark), sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(configure(spark), sf_dir, "embeddings"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = ngram_join.Jaccard(words=4, num=85, den=100)
    return ngram_join.join_components(table(configure(spark), sf_dir, "documents"), rule)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(configure(spark), sf_dir, "documents"), TOKENIZER)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(configure(spark), sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, SHARD_BYTES).drop("text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(configure(spark), sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(configure(spark), sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(configure(spark), sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a cache of this call's own, so that every run does the whole work."""
    return token_counts.count_tokens(table(configure(spark), sf_dir, "documents"), PIECES)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(configure(spark), sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_quality_classifier, op3_best_fit_packing, op4_suffix_array_dedup, op5_warc,
        op6_sharding, op7_embedding_near_dedup, op8_mixing, op9_ngram_jaccard_join, op10_license_scan,
        op11_spelling_variants, op12_token_counts, op13_embedding_whitening,
    )
}

"""The operators applied to the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import (
    collocation, decontam, embed_dedup, jaccard_join, mixing, quality, sharding, spelling, suffix_dedup, token_count, toxicity, url_filter, warc,
)
from tillroll.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op2_decontamination(spark, folder):
    return decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_collocations(spark, folder):
    return collocation.collocations(table(spark, folder, "documents"))


@query
def op12_quality(spark, folder):
    return quality.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op13_spelling(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query
def op7_jaccard_join(spark, folder):
    return jaccard_join.jaccard_components(table(spark, folder, "documents"), 4, 85, 100)


@query
def op10_toxicity(spark, folder):
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_token_counts(spark, folder):
    return token_count.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_sharding(spark, folder):
    return sharding.shard_rows(table(spark, folder, "documents"), 16)


@query
def op4_mixing(spark, folder):
    return mixing.mixed_rows(table(spark, folder, "documents"))


@query
def op1_url_filter(spark, folder):
    return url_filter.judge(table(spark, folder, "pages"))


@query
def op8_warc(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op3_embedding_dedup(spark, folder):
    return embed_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query
def op5_suffix_dedup(spark, folder):
    return suffix_dedup.removals(table(spark, folder, "documents"))


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)

"""The queries ``opN_<name>`` over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import maxscore, mixing, ngram_join, warc

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import quantised, top_k

    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import read_digests, word_encoder, write_ids

    files = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_encoder(_tokenizer("word_bpe_49k.json")), end_id=2)
    return read_digests(files)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import edited_fingerprints

    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import digests, write_archives

    return digests(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nbsvm import quality

    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removal_digests

    return removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("word_bpe_49k.json"))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mixture": op2_mixture,
    "op3_maxscore": op3_maxscore,
    "op4_simple8b": op4_simple8b,
    "op5_ngram_join": op5_ngram_join,
    "op6_spotsigs": op6_spotsigs,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_repeats": op9_repeats,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixture": mixing.SQL,
    "op3_maxscore": maxscore.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op7_warc": warc.SQL,
}

"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, quality

    docs = _table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tool_calls import CHAT_SCHEMAS, as_tool_chat, linked

    return linked(as_tool_chat(_table(spark, sf_dir, "conversations")), CHAT_SCHEMAS)


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    return sharded(_table(spark, sf_dir, "documents"))


def op1_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import audio, digests

    return digests(audio(_table(spark, sf_dir, "documents")))


def op6_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .inner_products import top_products

    return top_products(_table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs

    return periodic_runs(_table(spark, sf_dir, "documents"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op5_source_mixing": op5_source_mixing,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op7_tool_calls": op7_tool_calls,
    "op8_jump_sharding": op8_jump_sharding,
    "op1_line_block_text": op1_line_block_text,
    "op4_audio_features": op4_audio_features,
    "op6_top_inner_products": op6_top_inner_products,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_repeated_passages": op12_repeated_passages,
    "op13_merkle_manifest": op13_merkle_manifest,
}

"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, gam, lines, media, minhash, mixing, pieces, rules, shards, substrings
from .common import read


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(minhash.near_classes(read(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(read(spark, sf_dir, "documents")))


def op3_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup_substrings(read(spark, sf_dir, "documents")))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; it is installed on every machine, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_table(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), keep_ids=False))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return gam.digest(gam.score(documents, gam.learn(documents, read(spark, sf_dir, "labels"))))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.count_table(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.copy_classes(media.conversation_media(read(spark, sf_dir, "conversations")), "media_id", "image"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(shards.shard(read(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(rules.quality_rules(read(spark, sf_dir, "documents")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_cover_dedup": op3_cover_dedup,
    "op4_image_copies": op4_image_copies,
    "op5_byte_shards": op5_byte_shards,
    "op6_bpe_automaton": op6_bpe_automaton,
    "op7_quality_gam": op7_quality_gam,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mix": op10_source_mix,
}

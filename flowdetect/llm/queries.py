"""The operators applied to their whole tables: one query per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdetect.llm import (
    bpe,
    exact_dedup,
    html_extract,
    minhash,
    neighbours,
    packing,
    quality_classifier,
    quality_rules,
    ranked_search,
    sharding,
    substring_dedup,
    suffix_dedup,
    whitening,
)
from flowdetect.llm.common import read_table

#: Vocabulary files, by the name that the tokenizer package gives them.
PACKING_VOCABULARY = "word_bpe_49k.json"
BPE_VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents (shingles of four words, similarity 0.8)."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and the shard after growth of every document."""
    placed = sharding.assign_shards(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    parts = packing.pieces(read_table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY))
    return packing.pack(parts)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op6_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that repeats an earlier one, exactly or nearly, with its place in both documents."""
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the rows that are not held out."""
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, id digest and decoded digest of every document."""
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), vocabulary(BPE_VOCABULARY))


def op10_radix_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in strings of 100 bytes that also start earlier."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op11_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened coordinates of every embedding."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every embedding whose id is divisible by 100."""
    return neighbours.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op13_presence_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked_search.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_superminhash_dedup": op1_superminhash_dedup,
        "op2_jump_sharding": op2_jump_sharding,
        "op3_pack_sequences": op3_pack_sequences,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_chained_passages": op6_chained_passages,
        "op7_html_main_text": op7_html_main_text,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_radix_suffix_dedup": op10_radix_suffix_dedup,
        "op11_polarisation_whitening": op11_polarisation_whitening,
        "op12_cross_polytope_neighbours": op12_cross_polytope_neighbours,
        "op13_presence_mask_search": op13_presence_mask_search,
    }

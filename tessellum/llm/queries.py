"""The thin queries over the driver's tables: each reads whole tables, calls its operator and gives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens, whether they are over 2048, and how many characters fit that many, of every text."""
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and the digests of the ids and of what they decode to, of every text."""
    import public_tokenizers

    from .byte_bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry scores of every text, learned outside the fold."""
    from .quality_rank import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, fold=0, threshold=0.3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text, with terms and weights learned outside the fold."""
    from .toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, fold=1, threshold=0.7)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text, base kinds counted and digested."""
    from .secrets import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text that stand in windows of fifty of an earlier document, and the digest of the others."""
    from .substring_dedup import kept_words

    return kept_words(table(spark, sf_dir, "documents"), length=50, digest=True)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by fixed rules and the verdict of the ratio for every text."""
    from .quality_rules import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least 0.8 of an item's five-word shingles."""
    from .decontaminate import pairs

    return pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8, size=5)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and the least doc_id reachable over links of four bits."""
    from .simhash import grouped

    got = grouped(table(spark, sf_dir, "documents"), threshold=4, shingle=4)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text in strings of 200 that stand anywhere else, and the digest of the others."""
    from .run_index import kept_bytes

    return kept_bytes(table(spark, sf_dir, "documents"), length=200, digest=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and the digests of the ids and of what they decode to, of every text; words encoded over a trie."""
    import public_tokenizers

    from .prefix_trie import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in every text, and how the links count in the whole corpus."""
    import public_tokenizers

    from .alignment import aligned

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every text towards the benchmark's words, and the tenth of the documents that is drawn by them."""
    from .importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), target_id="item_id", length=1, buckets=10_000, seed="2024", least=20, percent=10)


ALL = (
    op1_token_counts,
    op2_byte_bpe,
    op3_quality_rank,
    op4_toxicity,
    op5_secret_scan,
    op6_substring_dedup,
    op7_quality_rules,
    op8_decontaminate,
    op9_simhash,
    op10_run_index,
    op11_prefix_trie,
    op12_alignment,
    op13_importance,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, importance, secrets, substring_dedup

    return {
        "op5_secret_scan": secrets.oracle(),
        "op6_substring_dedup": substring_dedup.oracle(length=50),
        "op8_decontaminate": decontaminate.oracle(threshold=0.8, size=5),
        "op13_importance": importance.oracle(),
    }

"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path() -> str:
    """The word-level vocabulary, where its package keeps it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path(), emit_ids=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find_pii(documents(spark, sf_dir))
    counts = [pii.count_of(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("pii"), base_only=True), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    out = assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_column

    return media_column(documents(spark, sf_dir), keep_media=False)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(documents(spark, sf_dir), tokenizer_path(), outputs=False)


def op9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spans import drop_repeats

    return drop_repeats(documents(spark, sf_dir)).select("doc_id", "text", "n_sentences", "n_removed", "removed_bytes", "emptied")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import rate_toxicity

    return rate_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_pii, op3_simhash, op4_lm, op5_quality, op6_html, op7_media, op8_bpe, op9_spans, op10_toxicity)}

#: DuckDB SQL where it can express a query whole; the rest have brute-force tests.
ORACLE_SQL: dict[str, str] = {}

"""The corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes the documents its predecessor kept and all but the last return documents' columns. Stages with
several passes over their input rely on its being a table, so ``run`` writes each result to the shared
folder and reads it back, as a scheduler would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polytrace.llm import common, packing, pii, shingles, spans, toxicity
from polytrace.llm.queries import tokenizer_path


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, does not reject."""
    return toxicity.rate_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, Jaccard similarity 0.8 or more): the one with the smallest id."""
    return shingles.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; those left without a word go."""
    return recounted(spans.drop_repeats(docs).where("not emptied").select(*docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    return recounted(pii.mask_pii(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as packing returns them."""
    return packing.pack(docs, tokenizer_path(), emit_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The models, merges and sums of slack of these stages have no SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents. When a stage's result is written, what it and its predecessors stored is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), tuple(common.tables(spark))
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(spark, keep=(*before, common.tables(spark)[-1]))
    return STAGES[-1][1](spark, docs, sf_dir)

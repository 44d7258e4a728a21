"""From transcribed documents to tokens: five stages, each one of the operators for training data.

Between stages the documents are written as Parquet in the shared checkpoint folder and read again, so a lost executor
never repeats an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm import language, leaks, repeats, tokens, verified_copies
from inkgrid.llm.common import written
from inkgrid.session import ship_package


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language describes go: no letters, or a code longer than the text itself."""
    ship_package(spark)
    judged = language.identify_languages(spark, docs, language.fit_trees(docs.select("lang", "text")))
    return judged.filter(language.recognised()).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines stay in one document only; documents of which nothing is left go."""
    ship_package(spark)
    cleaned = repeats.drop_repeated_runs(docs)
    left = cleaned.filter((F.col("removed_lines") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of similar documents stays: five-word shingles, similarity 0.8, each that goes is similar to one that stays."""
    ship_package(spark)
    return verified_copies.without_similar(docs).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    ship_package(spark)
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, and as the text these decode to."""
    ship_package(spark)
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = tokens.encode_texts(docs, ranks, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        tokens.decoded(F.col("token_ids"), ranks).cast("string").alias("text"),
    )


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", copies_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("bpe", token_stage),
]

#: Trees of contexts, byte merges and seeded hashes have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: ``doc_id``, ``n_tokens``, ``token_ids`` and decoded ``text`` of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remove = None
    for _, stage in STAGES[:-1]:
        docs, following = written(stage(spark, docs, sf_dir))
        if remove:
            remove()
        remove = following
    return STAGES[-1][1](spark, docs, sf_dir)

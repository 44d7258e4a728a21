"""The operators of this subpackage over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm import (
    html_text, infill, language, leaks, near_copies, private, quality, quotes, repeats, severity, sketches, tokens, whitening
)
from inkgrid.llm.common import sha256_utf8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    trees = language.fit_trees(documents.filter(~held_out()).select("lang", "text"))
    judged = language.identify_languages(spark, documents.select("doc_id", "text"), trees)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), sha256_utf8(F.col("text")).alias("text_sha256"), "removed_lines"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = html_text.extract_main_text(table(spark, sf_dir, "pages"))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("following", F.lit(1), half))
    versions = sketches.with_following(documents).withColumn("edited", edited)
    compared = sketches.fingerprint_versions(versions, ["edited", "following"])
    return compared.select(
        "doc_id", n.cast("long").alias("n_chars"), sha256_utf8(F.col("edited")).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", F.col("edited_likeness").alias("near_edited"), F.col("following_likeness").alias("near_next"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit_quality(documents, table(spark, sf_dir, "labels"))
    return quality.score_quality(documents, model).select("doc_id", "quality_score", "keep")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = tokens.encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), sha256_utf8(ids).alias("ids_sha256"),
        F.sha2(tokens.decoded(F.col("token_ids"), ranks), 256).alias("decoded_sha256"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_copies.near_copies(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return classes.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link_quotations(table(spark, sf_dir, "conversations"))
    return linked.withColumn("text", sha256_utf8(F.col("text"))).withColumnRenamed("text", "text_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") > 0).alias("severe"))
    scored = severity.score_severity(documents, severity.fit_severity(documents, marks))
    return scored.select("doc_id", "expected_severity", F.col("severe").alias("toxic"))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = private.find_private_spans(documents, private.fit_private_model(documents))
    base = F.filter("private_spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])

    def count(kind: str) -> Column:
        return F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")), sha256_utf8(private.listed_spans(base)).alias("base_sha256"),
        private.listed_spans(F.col("private_spans")).alias("spans"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        sha256_utf8(F.col("infill")).alias("output_sha256"),
        sha256_utf8(infill.restored(F.col("infill"), F.col("form"))).alias("restored_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    placed = whitening.whiten(embeddings, whitening.fit_whitening(embeddings))
    return placed.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_quotation_linking": op9_quotation_linking,
    "op10_toxicity": op10_toxicity,
    "op11_private_data": op11_private_data,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE: dict[str, str] = {}

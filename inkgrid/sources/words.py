"""Readers of words: recorded pages, OCR result tables, native word tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.functions.tokens import px_to_points
from inkgrid.schemas import RECORDED_PAGE, RECORDED_WORDS

_WORD = ["text", "x0", "x1", "top", "bottom", "confidence"]


def read_recorded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(words, pages)`` from recorded pages: one JSON array of pages per file, gzip or plain.

    The document id is the file name up to its first dot.
    """
    read = (
        spark.read.schema(RECORDED_PAGE)
        .option("multiLine", True)
        .json(path)
        .withColumn(
            "doc_id",
            F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1),
        )
    )
    pages = read.select("doc_id", "page", "width", "height", "source")
    return explode_recorded(read), pages


def explode_recorded(pages: DataFrame) -> DataFrame:
    """Words of pages that carry them as an array, in recorded order."""
    return pages.select("doc_id", "page", F.posexplode("words").alias("word_seq", "w")).select(
        "doc_id", "page", "word_seq", *[F.col(f"w.{c}") for c in _WORD]
    )


def record_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """The reverse of ``explode_recorded``; coordinates rounded to two decimals."""
    word = F.struct(
        F.col("text"),
        *[F.round(c, 2).alias(c) for c in ("x0", "x1", "top", "bottom")],
        F.col("confidence"),
    )
    listed = words.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("word_seq", word.alias("w")))).alias("_w")
    )
    none = F.array().cast(RECORDED_WORDS)
    return pages.join(listed, ["doc_id", "page"], "left").select(
        "doc_id", "page", "width", "height", "source", F.coalesce(F.col("_w.w"), none).alias("words")
    )


def ocr_words(rows: DataFrame) -> DataFrame:
    """Words of an OCR result table, pixels turned into points.

    Structure rows (confidence below 0), rows without a numeric confidence and
    blank texts are not words. A low confidence is kept: it is information.
    """
    conf = F.col("conf").try_cast("double")
    left, top = (px_to_points(F.col(c), F.col("dpi")) for c in ("left", "top"))
    width, height = (px_to_points(F.col(c), F.col("dpi")) for c in ("width", "height"))
    return rows.where((F.trim("text") != "") & (conf >= 0)).select(
        "doc_id",
        "page",
        "word_seq",
        F.trim("text").alias("text"),
        left.alias("x0"),
        (left + width).alias("x1"),
        top.alias("top"),
        (top + height).alias("bottom"),
        conf.alias("confidence"),
    )


def native_words(rows: DataFrame) -> DataFrame:
    """Words of a text layer; they have no confidence, which is not the same as full confidence."""
    return rows.where(F.trim("text") != "").select(
        "doc_id",
        "page",
        "word_seq",
        "text",
        *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")],
        F.lit(None).cast("double").alias("confidence"),
    )


def words_per_page(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Word count of every page, empty pages included."""
    counts = words.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return pages.select("doc_id", "page").join(counts, ["doc_id", "page"], "left").select(
        "doc_id", "page", F.coalesce("n", F.lit(0)).alias("n_words")
    )


def choose_source(
    words: DataFrame, pages: DataFrame, min_words: int = fixed.MIN_WORDS_TEXT_LAYER
) -> DataFrame:
    """Source of each page, decided page by page: too few native words means OCR."""
    return words_per_page(words, pages).withColumn(
        "source", F.when(F.col("n_words") < min_words, F.lit(fixed.OCR)).otherwise(F.lit(fixed.NATIVE))
    )


def replace_pages(
    native: DataFrame, ocr: DataFrame, ocr_pages: DataFrame, chosen: DataFrame
) -> DataFrame:
    """Native words, with the words of OCR instead on pages chosen for OCR and delivered by it.

    A page chosen for OCR that OCR did not deliver keeps its native words. The keys of pages are hashed, a row a page at
    most; words pass by them and are never sorted.
    """
    key = ["doc_id", "page"]
    replaced = (
        chosen.where(F.col("source") == fixed.OCR)
        .select(*key)
        .join(ocr_pages.select(*key).distinct(), key, "left_semi")
        .distinct()
        .hint("shuffle_hash")
    )
    return native.join(replaced, key, "left_anti").unionByName(
        ocr.join(replaced, key, "left_semi")
    )


def confidence_stats(words: DataFrame, correct) -> DataFrame:
    """How confidence spreads over the words that ``correct`` accepts, per document."""
    return (
        words.where(correct & F.col("confidence").isNotNull())
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n"),
            F.min("confidence").alias("min_conf"),
            F.expr("percentile(confidence, 0.1)").alias("p10_conf"),
            F.expr("percentile(confidence, 0.5)").alias("median_conf"),
            F.count_if(F.col("confidence") < 30).alias("below_30"),
        )
    )

"""Published totals of documents and small page statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timecard_totals(days: DataFrame) -> DataFrame:
    """Pages, days, punches and marked days of each time card."""
    return days.groupBy("doc_id").agg(
        F.count_distinct("page_pos").alias("pages"),
        F.count("*").alias("days"),
        F.sum("n_punches").alias("punches"),
        F.count_if("marked").alias("marked"),
    )


def payslip_totals(entries: DataFrame) -> DataFrame:
    """Entries, fields, bases and marked entries of each payslip document."""
    return entries.groupBy("doc_id").agg(
        F.count("*").alias("entries"),
        F.sum("n_fields").alias("fields"),
        F.sum("n_bases").alias("bases"),
        F.count_if("marked").alias("marked"),
    )


def median_height(words: DataFrame) -> DataFrame:
    """Median word height of a page, over positive heights."""
    height = F.col("bottom") - F.col("top")
    return words.groupBy("doc_id", "page").agg(
        F.median(F.when(height > 0, height)).alias("median_height")
    )


def mean_width(placed: DataFrame) -> DataFrame:
    """Mean word width of a line, over positive widths."""
    width = F.col("x1") - F.col("x0")
    return placed.groupBy("doc_id", "page", "line_no").agg(
        F.avg(F.when(width > 0, width)).alias("mean_width")
    )

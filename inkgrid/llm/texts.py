"""From transcribed pages to the texts of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.operators.geometry import build_lines, page_text


def document_texts(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(``doc_id``, ``text``): the visual lines of all pages of each document in order, one below the other.

    ``words`` are positioned words as everywhere in this library. Pages without words add nothing; documents that have
    only such pages appear, with an empty text, if ``pages`` (``doc_id``, ``page``) is given. A document is limited to
    some fifty pages by intake, so its pages can be gathered. Columns beyond the named ones are not read.
    """
    lined = page_text(build_lines(words))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    texts = lined.groupBy("doc_id").agg(F.array_join(ordered["text"], "\n").alias("text"))
    if pages is None:
        return texts
    every = pages.select("doc_id").distinct()
    return every.join(texts, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))

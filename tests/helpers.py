"""Hand-made pages: each line is ``(top, [(text, x0), ...])``."""

from inkgrid.plans.transcribe import matched_lines
from inkgrid.schemas import PAGES, WORDS


def word_rows(doc_id, page, lines, height=10.0):
    rows = []
    for top, words in lines:
        for text, x0 in words:
            x1 = x0 + 5.0 * len(text)
            rows.append(
                (doc_id, page, len(rows), text, float(x0), x1, float(top), top + height, None)
            )
    return rows


def tables(spark, docs, width=595.0):
    """``docs``: ``{doc_id: [page lines, ...]}`` to words and pages."""
    words, pages = [], []
    for doc_id, doc_pages in docs.items():
        for n, lines in enumerate(doc_pages, 1):
            words += word_rows(doc_id, n, lines)
            pages.append((doc_id, n, width, 842.0, "texto_nativo"))
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(pages, PAGES)


def read(spark, docs, width=595.0):
    words, pages = tables(spark, docs, width)
    return matched_lines(words, pages), pages

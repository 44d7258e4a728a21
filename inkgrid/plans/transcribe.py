"""From words to nested values, for a whole corpus in one job.

The words are shuffled once, by page. Their lines are written once, bucketed by page, in a folder for each set of layouts
that a page qualifies for; the choice of the layout reads narrow columns of that table, and each builder opens only the
folders that hold pages of its documents. None of them shuffles the lines again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.operators import geometry
from inkgrid.operators.choice import page_fits, score_layouts, select_layout
from inkgrid.operators.geometry import PAGE, build_lines, move_lines
from inkgrid.operators.headers import attach_page_width, match_headers
from inkgrid.plans.coded import CodedLayout, check_registry, coded_rows, coded_scores
from inkgrid.plans.layouts import BLOCKS, LAYOUTS, LEDGER, MONTHLY, RECEIPT, Layout
from inkgrid.plans.payslip import (
    block_entries,
    ledger_entries,
    monthly_entries,
    receipt_entries,
    with_all_pages,
)
from inkgrid.plans.timecard import DAY_BUILDERS
from inkgrid.session import stage, stage_bucketed
from inkgrid.sources.intake import page_counts, too_many_pages

ENTRY_BUILDERS = {
    MONTHLY.layout_id: monthly_entries,
    RECEIPT.layout_id: receipt_entries,
    BLOCKS.layout_id: block_entries,
    LEDGER.layout_id: ledger_entries,
}

PAGES_PER_TASK = geometry.PAGES_PER_TASK

#: What ``transcribe`` has written for each result that is still in use.
_releases: dict[int, tuple[dict[str, DataFrame], list[Callable[[], None]]]] = {}


def page_partitions(pages: DataFrame) -> int:
    """Partitions of the words: their number follows the pages, so that the words held by one task stay in its memory."""
    return geometry.page_partitions(pages, PAGES_PER_TASK)


def matched_lines(
    words: DataFrame, pages: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """Lines with page width and header matches: what scoring and every builder read."""
    return _matched(words, pages, layouts, page_partitions(pages))


def builder_lines(words: DataFrame, pages: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The same for a builder that reads straight from words: moved by page after Python, into as many partitions.

    Lines without titles to match never went to Python; those of receipts move after their months.
    """
    n = page_partitions(pages)
    matched = _matched(words, pages, layouts, n)
    moves = any(layout.titles for layout in layouts) and RECEIPT not in layouts
    return move_lines(matched, n) if moves else matched


def _matched(words: DataFrame, pages: DataFrame, layouts: tuple[Layout, ...], n: int) -> DataFrame:
    return match_headers(attach_page_width(build_lines(words, partitions=n), pages), layouts)


def choose(matched: DataFrame, documents: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    return select_layout(documents, score_layouts(matched, layouts))


def choose_coded(
    matched: DataFrame, documents: DataFrame, pages: DataFrame, coded: tuple[CodedLayout, ...], max_pages: int = fixed.MAX_PAGES
) -> DataFrame:
    """The same with layouts in code among the configured ones; they see no document over the page limit."""
    if not coded:
        return choose(matched, documents)
    bounded = documents.join(over_limit(pages, max_pages), "doc_id", "left_anti")
    return select_layout(documents, score_layouts(matched).unionByName(coded_scores(matched, bounded, coded)))


def over_limit(pages: DataFrame, max_pages: int = fixed.MAX_PAGES) -> DataFrame:
    return page_counts(pages).where(F.col("n_pages") > max_pages)


def within_limit(chosen: DataFrame, pages: DataFrame, max_pages: int = fixed.MAX_PAGES) -> DataFrame:
    """``chosen`` with documents over the page limit refused: no layout, and the text the user is told."""
    joined = chosen.join(over_limit(pages, max_pages), "doc_id", "left")
    fits = F.col("n_pages").isNull()
    kept = [F.when(fits, F.col(name)).alias(name) for name in ("layout_id", "layout", "score")]
    error = F.when(fits, F.col("error")).otherwise(too_many_pages(F.col("n_pages"), max_pages))
    return joined.select("doc_id", "doc_type", *kept, error.alias("error"))


def store_lines(matched: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, Callable[[], None]]:
    """Lines with ``fits``, the layouts their page qualifies for, on disk and bucketed by page; and how to remove them."""
    return stage_bucketed(matched.withColumn("fits", page_fits(layouts)), PAGE, "fits")


def store_chosen_pages(pages: DataFrame, chosen: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Pages of recognised documents with their layout, narrow, bucketed like the lines."""
    of_layout = pages.join(chosen.where("layout_id IS NOT NULL").select("doc_id", "layout_id"), "doc_id")
    narrow = of_layout.select(*PAGE, "layout_id")
    buckets = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage_bucketed(narrow.repartition(buckets, *PAGE), PAGE, "layout_id", buckets)


def folders_of(lines: DataFrame, chosen_pages: DataFrame) -> dict[int, list[int]]:
    """For each layout the values of ``fits`` on pages of its documents: at most 2 ** layouts numbers for each."""
    met = lines.where("line_no = 0").select(*PAGE, "fits").join(chosen_pages, list(PAGE))
    folders: dict[int, list[int]] = {}
    for row in met.select("layout_id", "fits").distinct().collect():
        folders.setdefault(row["layout_id"], []).append(row["fits"])
    return folders


def lines_of(lines: DataFrame, chosen_pages: DataFrame, folders: dict[int, list[int]], layout_id: int) -> DataFrame:
    """Lines of the documents of one layout; both sides are bucketed by page."""
    own = chosen_pages.where(F.col("layout_id") == layout_id).select(*PAGE)
    return lines.where(F.col("fits").isin(folders.get(layout_id, []))).drop("fits").join(own, list(PAGE))


def transcribe(
    words: DataFrame,
    pages: DataFrame,
    documents: DataFrame,
    max_pages: int = fixed.MAX_PAGES,
    strict: bool = True,
    coded: tuple[CodedLayout, ...] = (),
) -> dict[str, DataFrame]:
    """Everything read from a corpus: ``choice``, ``days``, ``entries``.

    ``documents`` has ``doc_id, doc_type``. Documents no layout fits, and those of
    more than ``max_pages`` pages, stay in ``choice`` with their error text. Unless ``strict``, payslips keep damaged
    amounts too, marked. ``coded`` are further layouts, in code (``inkgrid.plans.coded``).
    The frames read tables beside the checkpoints until ``release_transcription`` is called with the result.
    """
    check_registry(coded)
    lines, release_lines = store_lines(matched_lines(words, pages))
    chosen = stage(within_limit(choose_coded(lines, documents, pages, coded, max_pages), pages, max_pages))
    chosen_pages, release_pages = store_chosen_pages(pages, chosen)
    folders = folders_of(lines, chosen_pages)

    def read(layout_id: int) -> DataFrame:
        return lines_of(lines, chosen_pages, folders, layout_id)

    def pages_of(layout_id: int) -> DataFrame:
        return chosen_pages.where(F.col("layout_id") == layout_id).select(*PAGE)

    days = [build(read(k)) for k, build in DAY_BUILDERS.items()]
    entries = [build(read(k), pages_of(k), strict=strict) for k, build in ENTRY_BUILDERS.items()]
    for layout in coded:
        rows = coded_rows(read(layout.layout_id), layout)
        if layout.doc_type == fixed.TIMECARD:
            days.append(rows)
        else:
            entries.append(with_all_pages(rows, pages_of(layout.layout_id)))
    out = {
        "choice": chosen, "days": reduce(DataFrame.unionByName, days), "entries": reduce(DataFrame.unionByName, entries)
    }
    _releases[id(out)] = (out, [release_lines, release_pages])
    return out


def release_transcription(out: dict[str, DataFrame]) -> None:
    """Remove the tables that ``days`` and ``entries`` of ``transcribe`` read; they hold the texts of the documents."""
    _, releases = _releases.pop(id(out), (None, []))
    for release in releases:
        release()

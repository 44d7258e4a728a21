"""Table headers: which line carries all titles, and the column ranges it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.functions.similarity import plausible, title_matcher
from inkgrid.functions.text import normalize_text
from inkgrid.operators.geometry import PAGE, in_page
from inkgrid.plans.layouts import Layout, fold_title


def _candidate(words: Column, titles: tuple[str, ...], threshold: float) -> Column:
    """Necessary condition: enough words, and one each that may be the first and last title."""
    return (
        (F.size(words) >= len(titles))
        & F.exists(words, lambda w: plausible(w["norm"], titles[0], threshold))
        & F.exists(words, lambda w: plausible(w["norm"], titles[-1], threshold))
    )


def match_headers(
    lines: DataFrame, layouts: tuple[Layout, ...], threshold: float = fixed.TITLE_THRESHOLD
) -> DataFrame:
    """Add ``matches``: per layout whose titles all stand on the line, score and word positions.

    The greedy in-order match runs in one Arrow function, and only for lines
    that pass the JVM condition; for the others it receives NULL.
    """
    titled = [layout for layout in layouts if layout.titles]
    folded = {layout.layout_id: layout.folded for layout in titled}
    ids = F.array_compact(
        F.array(
            *[
                F.when(_candidate(F.col("words"), titles, threshold), F.lit(layout_id))
                for layout_id, titles in folded.items()
            ]
        )
    )
    matcher = title_matcher(folded, threshold)
    return (
        lines.withColumn("_ids", ids)
        .withColumn("_norms", F.when(F.size("_ids") > 0, F.col("words.norm")))
        .withColumn("matches", matcher("_norms", "_ids"))
        .drop("_ids", "_norms")
    )


def column_ranges(words: Column, at: Column, titles: tuple[str, ...], width: Column) -> Column:
    """Contiguous ranges: borders halfway between neighbouring titles, the page edges outside."""
    last = len(titles) - 1
    names = F.array(*[F.lit(t) for t in titles])

    def one(position: Column, i: Column) -> Column:
        word = F.get(words, position)
        before = F.get(words, F.get(at, i - 1))
        after = F.get(words, F.get(at, i + 1))
        return F.struct(
            i.alias("ord"),
            F.get(names, i).alias("name"),
            F.when(i == 0, F.lit(0.0)).otherwise((before["x1"] + word["x0"]) / 2).alias("x0"),
            F.when(i == last, F.greatest(width, word["x1"]))
            .otherwise((word["x1"] + after["x0"]) / 2)
            .alias("x1"),
        )

    return F.transform(at, one)


def _header_of(layout: Layout) -> tuple[Column, Column]:
    """(header struct of this line or NULL, its rank) for one layout."""
    match = F.get(F.filter("matches", lambda m: m["layout"] == layout.layout_id), F.lit(0))
    header = F.struct(
        F.col("line_no").alias("header_line"),
        F.col("top").alias("header_top"),
        match["score"].alias("score"),
        column_ranges(F.col("words"), match["at"], layout.titles, F.col("width")).alias("cols"),
    )
    # best mean ratio; of equals, the first line in reading order
    rank = F.struct(match["score"].alias("s"), (-F.col("line_no")).alias("n"))
    return F.when(match.isNotNull(), header), F.when(match.isNotNull(), rank)


def with_header(matched: DataFrame, layout: Layout) -> DataFrame:
    """Attach the page's header of ``layout`` to each of its lines, as ``header``.

    ``matched`` needs ``matches`` and the page ``width``. A window on the page
    key, so no join and no second pass over the words.
    """
    header, rank = _header_of(layout)
    return matched.withColumn("header", F.max_by(header, rank).over(in_page()))


def detect_headers(matched: DataFrame, layouts: tuple[Layout, ...]) -> DataFrame:
    """One row per page and layout whose header is on the page."""
    found = matched.where(F.col("matches").isNotNull())
    options = []
    for layout in layouts:
        if layout.titles:
            header, rank = _header_of(layout)
            options.append(
                F.struct(
                    F.lit(layout.layout_id).alias("layout_id"),
                    rank.alias("rank"),
                    header.alias("header"),
                )
            )
    out = found.select(*PAGE, F.explode(F.array(*options)).alias("o")).where("o.rank IS NOT NULL")
    return (
        out.groupBy(*PAGE, F.col("o.layout_id").alias("layout_id"))
        .agg(F.max_by("o.header", "o.rank").alias("h"))
        .select(*PAGE, "layout_id", "h.header_line", "h.header_top", "h.score", "h.cols")
    )


def column_by_name(cols: Column, name: str) -> Column:
    """First column whose accent-free title equals the name; repeated titles need the ordinal."""
    wanted = fold_title(name)
    return F.get(F.filter(cols, lambda c: normalize_text(c["name"]) == wanted), F.lit(0))


def attach_page_width(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Width of the page on each line; the lines keep their partitioning by page."""
    # pages are hashed: lines are wide and need no sort for one number
    return lines.join(pages.select(*PAGE, "width").hint("shuffle_hash"), list(PAGE), "left")

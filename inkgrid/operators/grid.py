"""The sheet of a document, as a long table of cells.

``grid(doc_id, row..., col_pos, header, value, path)``. The long form is primary
because every document has its own columns; ``path`` says where a correction of
the cell belongs, empty when no field stands behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.functions.tokens import parse_date
from inkgrid.operators import findings
from inkgrid.operators.scans import chunked_scan, explode_span, read_once, salted_join

DAY = ["doc_id", "page_pos", "day_pos"]


def cell_path(*parts) -> Column:
    return F.concat_ws(".", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def max_punches(days: DataFrame) -> DataFrame:
    """Punches of the fullest day of a document and the column pairs it needs."""
    return days.groupBy("doc_id").agg(
        F.coalesce(F.max("n_punches"), F.lit(0)).alias("max_punches")
    ).withColumn("pairs", F.floor((F.col("max_punches") + 1) / 2).cast("int"))


def timecard_header(col_pos: Column) -> Column:
    pair = F.floor((col_pos + 1) / 2).cast("int").cast("string")
    side = F.when(col_pos % 2 == 1, F.lit(fixed.HEAD_IN)).otherwise(F.lit(fixed.HEAD_OUT))
    return F.when(col_pos == 0, F.lit(fixed.HEAD_DATE)).otherwise(F.concat_ws(" ", side, pair))


def timecard_grid(days: DataFrame, punches: DataFrame) -> DataFrame:
    """Rows are days; punches go to columns by position, whatever their kind.

    ``days`` has ``n_punches``. Cells are produced flat: the date, one per
    punch, and empty cells up to the widest day of the document.
    """
    days = read_once(days, *DAY)
    root = lambda *rest: cell_path("pages", F.col("page_pos"), "days", F.col("day_pos"), *rest)
    dates = days.select(
        *DAY, F.lit(0).alias("col_pos"), F.col("date_raw").alias("value"), root("date_raw").alias("path")
    )
    filled = punches.select(
        *DAY,
        (F.col("punch_pos") + 1).cast("int").alias("col_pos"),
        F.col("time_hhmm").alias("value"),
        root("punches", F.col("punch_pos"), "time_hhmm").alias("path"),
    )
    wide = salted_join(days, max_punches(days), ["doc_id"], F.struct("page_pos", "day_pos"))
    empty = explode_span(wide, F.col("n_punches") + 1, F.col("pairs") * 2, "col_pos").select(
        *DAY, "col_pos", F.lit("").alias("value"), F.lit("").alias("path")
    )
    cells = dates.unionByName(filled).unionByName(empty)
    return cells.withColumn("header", timecard_header(F.col("col_pos")))


def timecard_sheet(days: DataFrame) -> DataFrame:
    """The reviewed sheet of time cards in one scan of ``days`` (nested, with ``punches``).

    ``(doc_id, page_pos, day_pos, row_no, pairs, cells, codes, reasons, severity)``: ``cells`` are the date, the punches and
    empty cells up to the widest day of the document, each with value and path. The width of the document, the number of
    the row and the last legible date before it come from the same scan, so the builder behind ``days`` runs once and
    cells and findings of a row cannot get out of step.
    """
    flat = findings.summarise_nested_days(days, "punches").withColumn("_date", parse_date(F.col("date_raw")))
    chunk = F.floor(F.col("page_pos") / findings.PAGES_PER_CHUNK)
    scanned = chunked_scan(
        flat, ["doc_id"], ["page_pos", "day_pos"], chunk, {"_prev": "_date"}, {"_widest": "n_punches"}, "row_no"
    )
    pairs = F.floor((F.coalesce("_widest", F.lit(0)) + 1) / 2).cast("int")
    root = lambda *rest: cell_path("pages", F.col("page_pos"), "days", F.col("day_pos"), *rest)

    def cell(value: Column, path: Column) -> Column:
        return F.struct(value.alias("value"), path.alias("path"))

    filled = F.transform("punches", lambda p, i: cell(p["time_hhmm"], root("punches", i, "time_hhmm")))
    empty = F.array_repeat(cell(F.lit(""), F.lit("")), F.col("pairs") * 2 - F.size("punches"))
    cells = F.concat(F.array(cell(F.col("date_raw"), root("date_raw"))), filled, empty)
    broken = findings.breaks_chain(F.col("_date"), F.col("_prev"))
    return scanned.withColumn("pairs", pairs).select(
        *DAY, "row_no", "pairs", cells.alias("cells"), *findings.day_findings(broken)
    )


def label_union(fields: DataFrame) -> DataFrame:
    """Distinct field labels of a document in order of first appearance: ``label_no`` from 0.

    The aggregation reduces each label to its first place before the shuffle;
    what is ranked are the labels of a document, the columns of one sheet.
    """
    first = fields.groupBy("doc_id", "label").agg(
        F.min(F.struct("entry_pos", "field_pos")).alias("first")
    )
    order = Window.partitionBy("doc_id").orderBy("first")
    return first.select("doc_id", "label", (F.row_number().over(order) - 1).alias("label_no"))


def first_per_label(fields: DataFrame) -> DataFrame:
    """First value of each label in an entry, with its position."""
    return fields.groupBy("doc_id", "entry_pos", "label").agg(
        F.min(F.struct("field_pos", "value")).alias("f")
    ).select("doc_id", "entry_pos", "label", "f.field_pos", "f.value")


def payslip_grid(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows are entries; a column per label of the document, empty where the entry lacks it."""
    keys = ["doc_id", "entry_pos"]
    entries, fields = read_once(entries, *keys), read_once(fields, *keys)
    root = lambda *rest: cell_path("pages", F.col("entry_pos"), *rest)
    fixed_cells = F.array(
        *[
            F.struct(
                F.lit(pos).alias("col_pos"),
                F.lit(head).alias("header"),
                F.col(name).cast("string").alias("value"),
                (root(name) if pos else F.lit("")).alias("path"),
            )
            for pos, head, name in (
                (0, fixed.HEAD_PAGE, "page"),
                (1, fixed.HEAD_MONTH, "month"),
                (2, fixed.HEAD_YEAR, "year"),
            )
        ]
    )
    heads = entries.select(*keys, F.inline(fixed_cells))
    slots = salted_join(
        entries.select(*keys), label_union(fields), ["doc_id"], F.col("entry_pos")
    )
    values = slots.join(first_per_label(fields), [*keys, "label"], "left").select(
        *keys,
        (F.col("label_no") + 3).alias("col_pos"),
        F.col("label").alias("header"),
        F.coalesce("value", F.lit("")).alias("value"),
        F.when(F.col("field_pos").isNotNull(), root("fields", F.col("field_pos"), "value"))
        .otherwise(F.lit(""))
        .alias("path"),
    )
    return heads.unionByName(values)


def column_widths(grid: DataFrame) -> DataFrame:
    """Sheet column width: longest text, header included, plus 2, at most 40."""
    longest = F.greatest(F.max(F.char_length("value")), F.max(F.char_length("header")))
    return grid.groupBy("doc_id", "col_pos").agg(
        F.least(longest + 2, F.lit(fixed.MAX_COLUMN_WIDTH)).alias("width")
    )


def sheet_rows(grid: DataFrame, row: list[str]) -> DataFrame:
    """One row per sheet row with its cells ``array<struct<value, path>>`` in column order."""
    cells = F.array_sort(F.collect_list(F.struct("col_pos", "value", "path")))
    return grid.groupBy("doc_id", *row).agg(cells.alias("_c")).select(
        "doc_id",
        *row,
        F.transform("_c", lambda c: F.struct(c["value"].alias("value"), c["path"].alias("path"))).alias(
            "cells"
        ),
    )


def review_rows(grid: DataFrame, found: DataFrame, row: list[str]) -> DataFrame:
    """Sheet rows with their findings; the same columns as the sheet.

    Full join, so that a row without findings row, or the reverse, is seen by
    ``unmatched_rows`` rather than lost.
    """
    return sheet_rows(grid, row).join(found, ["doc_id", *row], "full")


def unmatched_rows(review: DataFrame) -> DataFrame:
    """Rows that have cells without findings or findings without cells; must be empty."""
    return review.where(F.col("cells").isNull() | F.col("codes").isNull())


def assert_in_step(review: DataFrame) -> DataFrame:
    """Fail the job at the row where sheet and findings are out of step."""
    broken = F.col("cells").isNull() | F.col("codes").isNull()
    return review.withColumn(
        "cells",
        F.when(broken, F.raise_error(F.lit("sheet rows and findings are out of step"))).otherwise(
            F.col("cells")
        ),
    )

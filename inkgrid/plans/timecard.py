"""Time-card builders: lines with a header to days and punches.

A layout is configuration (punch columns and kinds, how the day is read); the
three builders share the punch reader and differ in how lines become days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.functions.tokens import (
    compose_date,
    day_digits,
    day_prefix,
    read_clock,
    read_month_year,
    split_interval,
)
from inkgrid.operators.geometry import PAGE, cell_words, in_page, in_reading_order, so_far
from inkgrid.operators.headers import with_header
from inkgrid.plans.layouts import CONTINUATION, INTERVAL, PUNCH_COLUMNS, TABULAR, Layout


def page_month(marker: str, two_digits: bool = False) -> Column:
    """Month and year printed on the page: the first line with the marker decides."""
    line = F.when(F.contains("ntext", F.lit(marker)), F.col("line_no"))
    text = F.min_by("text", line).over(in_page())
    return read_month_year(text, two_digits)


def _clocks(words: Column, split: bool) -> Column:
    texts = words["text"]
    if split:
        texts = F.flatten(F.transform(texts, split_interval))
    # a token without a colon is no clock; most are ruled out here
    texts = F.filter(texts, lambda t: F.contains(t, F.lit(":")))
    return F.filter(F.transform(texts, read_clock), lambda c: c.isNotNull())


def _cell_punches(clocks: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.transform(
        clocks,
        lambda c, i: F.struct(
            F.get(names, F.least(i, F.lit(len(kinds) - 1))).alias("kind"),
            c["raw"].alias("time_raw"),
            c["norm"].alias("time_hhmm"),
        ),
    )


def line_punches(layout: Layout) -> Column:
    """Punches of a line, in column order; the kind comes from the column.

    In an interval cell the kinds alternate as configured and the last one
    repeats when there are more clocks than kinds.
    """
    cols = F.col("header.cols")
    return F.concat(
        *[
            _cell_punches(
                _clocks(cell_words(F.col("words"), cols, ordinal), layout is INTERVAL), kinds
            )
            for ordinal, kinds in PUNCH_COLUMNS[layout.layout_id]
        ]
    )


def _first_day(reader) -> Column:
    words = cell_words(F.col("words"), F.col("header.cols"), 0)
    return F.get(F.filter(F.transform(words["text"], reader), lambda d: d.isNotNull()), F.lit(0))


def is_below_header() -> Column:
    """False on pages without a header."""
    return F.coalesce(F.col("top") > F.col("header.header_top"), F.lit(False))


def below_header(df: DataFrame) -> DataFrame:
    return df.where(is_below_header())


def _one_line_days(lines: DataFrame, date_raw: Column, layout: Layout) -> DataFrame:
    """Every line with a day is a day of its own."""
    return (
        lines.withColumn("date_raw", date_raw)
        .where(F.col("date_raw").isNotNull())
        .withColumn("day_pos", F.row_number().over(in_reading_order()) - 1)
        .select(*PAGE, "day_pos", "date_raw", line_punches(layout).alias("punches"))
    )


def tabular_days(matched: DataFrame) -> DataFrame:
    """Full date printed on every line; eight punch columns."""
    lines = below_header(with_header(matched, TABULAR))
    printed = _first_day(lambda t: F.when(t.rlike(fixed.FULL_DATE), t))
    return _one_line_days(lines, printed, TABULAR)


def interval_days(matched: DataFrame) -> DataFrame:
    """Day number on the line, month on the page; intervals inside one cell."""
    lines = with_header(matched, INTERVAL).withColumn("_month", page_month(fixed.MARK_MONTH_YEAR))
    lines = below_header(lines).withColumn("_day", _first_day(day_prefix))
    date_raw = F.when(F.col("_day").isNotNull(), compose_date(F.col("_day"), F.col("_month")))
    return _one_line_days(lines, date_raw, INTERVAL)


def continuation_days(matched: DataFrame) -> DataFrame:
    """Lines without a day number, or repeating it, continue the last day of the page."""
    lines = with_header(matched, CONTINUATION).withColumn("_month", page_month(fixed.MARK_MONTH_YEAR))
    before = in_reading_order().rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        below_header(lines)
        .withColumn("_day", _first_day(day_digits))
        .withColumn("_open", F.last("_day", True).over(before))
        .withColumn("_new", F.col("_day").isNotNull() & ~F.col("_day").eqNullSafe(F.col("_open")))
        .withColumn("day_pos", F.sum(F.col("_new").cast("int")).over(so_far()) - 1)
        .where(F.col("day_pos") >= 0)
        .withColumn("punches", line_punches(CONTINUATION))
        .withColumn("_date", compose_date(F.col("_day"), F.col("_month")))
    )
    parts = F.array_sort(F.collect_list(F.struct("line_no", "punches")))
    return numbered.groupBy(*PAGE, "day_pos").agg(
        F.min_by("_date", "line_no").alias("date_raw"),
        F.flatten(parts["punches"]).alias("punches"),
    ).select(*PAGE, F.col("day_pos").cast("int").alias("day_pos"), "date_raw", "punches")


DAY_BUILDERS = {
    CONTINUATION.layout_id: continuation_days,
    TABULAR.layout_id: tabular_days,
    INTERVAL.layout_id: interval_days,
}


def flat_punches(days: DataFrame) -> DataFrame:
    """One row per punch, ``punch_pos`` from 0."""
    return days.select(
        *PAGE, "day_pos", F.posexplode("punches").alias("punch_pos", "punch")
    ).select(*PAGE, "day_pos", "punch_pos", "punch.*")


def nest_timecards(days: DataFrame, pages: DataFrame) -> DataFrame:
    """``(doc_id, value)``: the nested value; pages without days stay, with an empty list.

    One document is at most fifty pages (intake refuses more), which bounds the list.
    """
    day = F.struct("date_raw", "punches")
    by_page = days.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct("day_pos", day.alias("day")))).alias("_days")
    )
    none = F.array().cast(
        "array<struct<date_raw:string,punches:array<struct<kind:string,time_raw:string,time_hhmm:string>>>>"
    )
    whole = pages.select(*PAGE).join(by_page, list(PAGE), "left").select(
        *PAGE, F.coalesce(F.col("_days.day"), none).alias("days")
    )
    return whole.groupBy("doc_id").agg(
        F.struct(F.array_sort(F.collect_list(F.struct("page", "days"))).alias("pages")).alias("value")
    )

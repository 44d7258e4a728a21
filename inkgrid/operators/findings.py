"""Findings: what a person must look at, derived and never stored.

Input is flat. Time cards: ``days(doc_id, page_pos, day_pos, date_raw,
n_punches, marked)``. Payslips: ``entries(doc_id, entry_pos, year, month,
n_fields, n_bases, marked)``. ``marked`` says that any text of the row, shown or
not, holds a ``?``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.functions.text import contains_mark
from inkgrid.functions.tokens import date_shape, month_index, next_day, parse_date
from inkgrid.operators.scans import carry_last

# Pages per chunk of the ordered scan; a printed page holds a bounded number of rows.
PAGES_PER_CHUNK = 64
ENTRIES_PER_CHUNK = 4096

#: Not among the findings that users already know: only where entries carry ``month_ties``.
TIED_MONTH = (
    "competencia_ambigua",
    "O nome do mês está danificado e é igualmente parecido com mais de um mês.",
    fixed.YELLOW,
)


def has_uncertainty(texts: Column) -> Column:
    """Any text of the array holds a ``?``."""
    return F.exists(texts, contains_mark)


def summarise_days(days: DataFrame, punches: DataFrame) -> DataFrame:
    """Flat day rows from ``days(…, date_raw)`` and one row per punch.

    Counts merge before the shuffle; a day without punches stays.
    """
    keys = ["doc_id", "page_pos", "day_pos"]
    seen = punches.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.bool_or(contains_mark(F.col("time_raw")) | contains_mark(F.col("time_hhmm"))).alias("m"),
    )
    return days.join(seen, keys, "left").select(
        *keys,
        "date_raw",
        F.coalesce("n", F.lit(0)).cast("int").alias("n_punches"),
        (contains_mark(F.col("date_raw")) | F.coalesce("m", F.lit(False))).alias("marked"),
    )


def summarise_nested_days(days: DataFrame, *more: str) -> DataFrame:
    """The same from days that carry their punches as an array; ``more`` columns stay."""
    texts = F.concat(
        F.array("date_raw"), F.col("punches.time_raw"), F.col("punches.time_hhmm")
    )
    return days.select(
        "doc_id",
        (F.col("page") - 1).alias("page_pos"),
        "day_pos",
        "date_raw",
        F.size("punches").alias("n_punches"),
        has_uncertainty(texts).alias("marked"),
        *more,
    )


def summarise_entries(entries: DataFrame, fields: DataFrame, bases: DataFrame) -> DataFrame:
    """Entries of flat tables with counts of their fields and bases, and the mark of any text among them."""
    keys = ["doc_id", "entry_pos"]

    def counted(items: DataFrame, names: tuple[str, ...], out: str) -> DataFrame:
        marked = has_uncertainty(F.array(*names))
        return items.groupBy(*keys).agg(F.count("*").cast("int").alias(out), F.bool_or(marked).alias(f"_{out}"))

    joined = entries.join(counted(fields, ("code", "label", "reference", "value"), "n_fields"), keys, "left").join(
        counted(bases, ("label", "value"), "n_bases"), keys, "left"
    )
    own = has_uncertainty(F.array("month", "year"))
    return joined.select(
        *keys,
        "year",
        "month",
        F.coalesce("n_fields", F.lit(0)).alias("n_fields"),
        F.coalesce("n_bases", F.lit(0)).alias("n_bases"),
        (own | F.coalesce("_n_fields", F.lit(False)) | F.coalesce("_n_bases", F.lit(False))).alias("marked"),
    )


def summarise_nested_entries(entries: DataFrame, *more: str) -> DataFrame:
    """Flat entry rows from entries that carry fields and bases as arrays; ``more`` columns stay."""
    texts = F.concat(
        F.array("month", "year"),
        *[F.col(f"fields.{k}") for k in ("code", "label", "reference", "value")],
        *[F.col(f"bases.{k}") for k in ("label", "value")],
    )
    return entries.select(
        "doc_id",
        "entry_pos",
        "year",
        "month",
        F.size("fields").alias("n_fields"),
        F.size("bases").alias("n_bases"),
        has_uncertainty(texts).alias("marked"),
        *more,
    )


def find_odd_punches(n_punches: Column) -> Column:
    return n_punches % 2 == 1


def find_empty_page(n_fields: Column, n_bases: Column) -> Column:
    return (n_fields == 0) & (n_bases == 0)


def find_date_break(days: DataFrame) -> DataFrame:
    """Add ``date_break``: not the day after the last legible date of the document.

    The chain runs across pages. A date of the right shape that the calendar does
    not have is a break but does not move the chain; other text does neither.
    """
    order = ["page_pos", "day_pos"]
    dated = days.withColumn("_date", parse_date(F.col("date_raw")))
    chained = carry_last(
        dated, ["doc_id"], order, F.floor(F.col("page_pos") / PAGES_PER_CHUNK), "_date", "_prev"
    )
    return chained.withColumn("date_break", breaks_chain(F.col("_date"), F.col("_prev"))).drop("_date", "_prev")


def breaks_chain(date: Column, previous: Column) -> Column:
    """Whether a row's printed date does not follow the last legible one."""
    return F.when(date.isNull(), date_shape(F.col("date_raw"))).otherwise(
        F.coalesce(date != next_day(previous), F.lit(False))
    )


def find_month_break(entries: DataFrame) -> DataFrame:
    """Add ``month_break``: not the month after the last legible one of the document."""
    dated = entries.withColumn("_index", month_index(F.col("month"), F.col("year")))
    chained = carry_last(
        dated,
        ["doc_id"],
        ["entry_pos"],
        F.floor(F.col("entry_pos") / ENTRIES_PER_CHUNK),
        "_index",
        "_prev",
    )
    broken = F.coalesce(F.col("_index") != F.col("_prev") + 1, F.lit(False))
    return chained.withColumn("month_break", broken).drop("_index", "_prev")


def _listed(*found: tuple[Column, tuple[str, str, str]]) -> list[Column]:
    def pick(k: int) -> Column:
        return F.array_compact(F.array(*[F.when(hit, F.lit(f[k])) for hit, f in found]))

    red = F.lit(False)
    for hit, finding in found:
        if finding[2] == fixed.RED:
            red = red | hit
    codes = pick(0)
    return [
        codes.alias("codes"),
        pick(1).alias("reasons"),
        severity(red, F.size(codes) > 0).alias("severity"),
    ]


def severity(any_red: Column, any_finding: Column) -> Column:
    """Red wins over yellow; NULL without findings."""
    return F.when(any_red, F.lit(fixed.RED)).when(any_finding, F.lit(fixed.YELLOW))


def timecard_findings(days: DataFrame) -> DataFrame:
    """``codes``, ``reasons`` and ``severity`` per day, codes in the order odd, date, uncertain."""
    return find_date_break(days).select("doc_id", "page_pos", "day_pos", *day_findings(F.col("date_break")))


def day_findings(date_break: Column) -> list[Column]:
    """``codes``, ``reasons`` and ``severity`` of a day row with ``n_punches`` and ``marked``."""
    return _listed(
        (find_odd_punches(F.col("n_punches")), fixed.ODD_PUNCHES),
        (date_break, fixed.DATE_BREAK),
        (F.col("marked"), fixed.UNCERTAIN),
    )


def find_tied_month(month_ties: Column) -> Column:
    """The printed month name is equally similar to several months."""
    return F.size(month_ties) > 1


def payslip_findings(entries: DataFrame) -> DataFrame:
    """The same per entry, codes in the order empty, month, uncertain; then tied month, if ``entries`` has ``month_ties``."""
    found = [
        (find_empty_page(F.col("n_fields"), F.col("n_bases")), fixed.EMPTY_PAGE),
        (F.col("month_break"), fixed.MONTH_BREAK),
        (F.col("marked"), fixed.UNCERTAIN),
    ]
    if "month_ties" in entries.columns:
        found.append((find_tied_month(F.col("month_ties")), TIED_MONTH))
    return find_month_break(entries).select("doc_id", "entry_pos", *_listed(*found))


def review_summary(findings: DataFrame) -> DataFrame:
    """Rows of each document and how many need attention."""
    return findings.groupBy("doc_id").agg(
        F.count("*").alias("rows_total"),
        F.count_if(F.col("severity").isNotNull()).alias("rows_flagged"),
    )


def severity_style(df: DataFrame) -> DataFrame:
    """Fill of the row and left border of its first cell, as the sheet shows them."""
    return df.withColumn(
        "fill",
        F.when(F.col("severity") == fixed.RED, F.lit(fixed.FILL_RED)).when(
            F.col("severity") == fixed.YELLOW, F.lit(fixed.FILL_YELLOW)
        ),
    ).withColumn("left_border", F.when(F.col("severity") == fixed.RED, F.lit(fixed.BORDER_RED)))

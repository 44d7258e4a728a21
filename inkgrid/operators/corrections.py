"""Human corrections by cell path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid import fixed

TIMECARD_PATH = r"^pages\.([0-9]+)\.days\.([0-9]+)\.(date_raw|punches\.([0-9]+)\.(kind|time_raw|time_hhmm))$"
PAYSLIP_PATH = r"^pages\.([0-9]+)\.(month|year|(fields|bases)\.([0-9]+)\.(code|label|reference|value))$"
FIELD_TEXTS = ("code", "label", "reference", "value")
BASE_TEXTS = ("label", "value")


def latest(corrections: DataFrame) -> DataFrame:
    """Last correction of each path; the larger text decides between equal times."""
    return corrections.groupBy("doc_id", "path").agg(
        F.max_by("new_value", F.struct("ts", "new_value")).alias("new_value"),
        F.max("ts").alias("ts"),
    )


def _part(pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract("path", pattern, k), F.lit(""))


def split_timecard_path(corrections: DataFrame) -> DataFrame:
    """Path to ``page_pos, day_pos, punch_pos, name``; NULL name when it names nothing editable."""
    return corrections.select(
        "*",
        _part(TIMECARD_PATH, 1).try_cast("int").alias("page_pos"),
        _part(TIMECARD_PATH, 2).try_cast("int").alias("day_pos"),
        _part(TIMECARD_PATH, 4).try_cast("int").alias("punch_pos"),
        F.coalesce(_part(TIMECARD_PATH, 5), _part(TIMECARD_PATH, 3)).alias("name"),
    )


def split_payslip_path(corrections: DataFrame) -> DataFrame:
    """Path to ``entry_pos, section, item_pos, name``."""
    return corrections.select(
        "*",
        _part(PAYSLIP_PATH, 1).try_cast("int").alias("entry_pos"),
        _part(PAYSLIP_PATH, 3).alias("section"),
        _part(PAYSLIP_PATH, 4).try_cast("int").alias("item_pos"),
        F.coalesce(_part(PAYSLIP_PATH, 5), _part(PAYSLIP_PATH, 2)).alias("name"),
    )


def _apply(rows: DataFrame, edits: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """New values replace old ones by key; one row per key on the edit side."""
    wide = edits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, F.col("new_value"))).alias(f"_{n}") for n in names]
    )
    out = rows.join(wide, keys, "left")
    for name in names:
        out = out.withColumn(name, F.coalesce(f"_{name}", name))
    return out.drop(*[f"_{n}" for n in names])


def correct_timecards(
    days: DataFrame, punches: DataFrame, corrections: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Corrected ``days`` and ``punches``. Editing one text leaves the others, raw ones too."""
    edits = split_timecard_path(latest(corrections))
    day = ["doc_id", "page_pos", "day_pos"]
    return (
        _apply(days, edits.where("punch_pos IS NULL"), day, ["date_raw"]),
        _apply(
            punches,
            edits.where("punch_pos IS NOT NULL"),
            [*day, "punch_pos"],
            ["kind", "time_raw", "time_hhmm"],
        ),
    )


def correct_payslips(
    entries: DataFrame, fields: DataFrame, bases: DataFrame, corrections: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corrected ``entries`` (month, year), ``fields`` and ``bases``."""
    edits = split_payslip_path(latest(corrections))
    at_field = edits.where("section = 'fields'").withColumnRenamed("item_pos", "field_pos")
    at_base = edits.where("section = 'bases'").withColumnRenamed("item_pos", "base_pos")
    return (
        _apply(entries, edits.where("section IS NULL"), ["doc_id", "entry_pos"], ["month", "year"]),
        _apply(
            fields,
            at_field,
            ["doc_id", "entry_pos", "field_pos"],
            list(FIELD_TEXTS),
        ),
        _apply(bases, at_base, ["doc_id", "entry_pos", "base_pos"], list(BASE_TEXTS)),
    )


def rejected_corrections(corrections: DataFrame, paths: DataFrame) -> DataFrame:
    """Corrections whose path does not exist in the document; they change nothing."""
    return latest(corrections).join(paths.select("doc_id", "path"), ["doc_id", "path"], "left_anti")


def timecard_paths(days: DataFrame, punches: DataFrame) -> DataFrame:
    """All paths of a time card that a correction may name."""
    root = [F.lit("pages"), F.col("page_pos"), F.lit("days"), F.col("day_pos")]
    of_day = days.select("doc_id", F.concat_ws(".", *root, F.lit("date_raw")).alias("path"))
    names = F.explode(F.array(F.lit("kind"), F.lit("time_raw"), F.lit("time_hhmm")))
    of_punch = punches.withColumn("_n", names).select(
        "doc_id", F.concat_ws(".", *root, F.lit("punches"), F.col("punch_pos"), "_n").alias("path")
    )
    return of_day.unionByName(of_punch)


def payslip_paths(entries: DataFrame, fields: DataFrame, bases: DataFrame) -> DataFrame:
    """All paths of a payslip that a correction may name."""
    root = [F.lit("pages"), F.col("entry_pos")]

    def of_items(items: DataFrame, section: str, names: tuple[str, ...]) -> DataFrame:
        place = F.col(f"{section[:-1]}_pos")
        each = items.withColumn("_n", F.explode(F.array(*[F.lit(name) for name in names])))
        return each.select("doc_id", F.concat_ws(".", *root, F.lit(section), place, "_n").alias("path"))

    own = entries.withColumn("_n", F.explode(F.array(F.lit("month"), F.lit("year"))))
    of_entry = own.select("doc_id", F.concat_ws(".", *root, "_n").alias("path"))
    return of_entry.unionByName(of_items(fields, "fields", FIELD_TEXTS)).unionByName(of_items(bases, "bases", BASE_TEXTS))


def replace_values(transcriptions: DataFrame, updates: DataFrame) -> DataFrame:
    """Whole-value replacement: the last update of a known, finished id moves ``updated_at``.

    ``updates(id, value, ts)``. Status is untouched, so a failed document stays
    failed; documents in processing refuse.
    """
    last = updates.groupBy("id").agg(
        F.max_by("value", F.struct("ts", "value")).alias("_value"), F.max("ts").alias("_ts")
    )
    joined = transcriptions.join(last, "id", "left")
    takes = F.col("_ts").isNotNull() & (F.col("status") != fixed.PROCESSING)
    return (
        joined.withColumn("value", F.when(takes, F.col("_value")).otherwise(F.col("value")))
        .withColumn("updated_at", F.when(takes, F.col("_ts")).otherwise(F.col("updated_at")))
        .drop("_value", "_ts")
    )

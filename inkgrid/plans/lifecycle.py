"""Life of a document: an append-only log of events, its latest state, and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid import fixed


def lifecycle_status(log: DataFrame) -> DataFrame:
    """Latest state of each id from ``log(id, seq, doc_type, event, value, ts)``.

    Events: ``received``, ``done``, ``unknown_layout``, ``failure``. An error clears
    the value; an unknown layout has a readable text, any other failure a fixed one
    that shows nothing of the document. The last event is found by an aggregation
    that merges before the shuffle.
    """
    last = log.groupBy("id").agg(
        F.min(F.struct("ts", "seq")).alias("first"),
        F.max_by(F.struct("doc_type", "event", "value", "ts"), F.struct("ts", "seq")).alias("e"),
    )
    event = F.col("e.event")
    return last.select(
        "id",
        "e.doc_type",
        F.when(event == "received", F.lit(fixed.PROCESSING))
        .when(event == "done", F.lit(fixed.DONE))
        .otherwise(F.lit(fixed.FAILED))
        .alias("status"),
        F.when(event == "unknown_layout", F.lit(fixed.MSG_UNKNOWN_LAYOUT))
        .when(event == "failure", F.lit(fixed.MSG_FAILURE))
        .alias("error"),
        F.when(event == "done", F.col("e.value")).alias("value"),
        F.col("first.ts").alias("created_at"),
        F.col("e.ts").alias("updated_at"),
    )


def expired(created_at: Column, as_of: Column, hours: int = fixed.RETENTION_HOURS) -> Column:
    """Strictly older than the window, by creation and whatever the status."""
    return created_at < as_of - F.make_dt_interval(F.lit(0), F.lit(hours))


def expire(
    transcriptions: DataFrame, as_of: Column, hours: int = fixed.RETENTION_HOURS
) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)``; the source files of the removed rows go too."""
    gone = expired(F.col("created_at"), as_of, hours)
    return transcriptions.where(~gone), transcriptions.where(gone)

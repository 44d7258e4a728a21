"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.session import ensure_checkpoint_dir


def kept(df: DataFrame) -> DataFrame:
    """Write a narrow table once to the shared checkpoint folder and read it from there.

    For tables that a later plan reads more than once. Never texts, only ids and numbers.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Write a table of texts as Parquet beside the checkpoints; the second value removes it again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), remove


def drawn_labels(labels: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows of ``labels`` at most, drawn by a hash of ``doc_id``: few enough to be broadcast."""
    share = min(1.0, bound / max(1, labels.count()))
    drawn = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003 < share)
    return F.broadcast(drawn)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sha256_utf8(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)

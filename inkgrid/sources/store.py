"""Stored tables that change: expiry of transcriptions, and the log of corrections with its snapshots.

Both work on whole folders through the Hadoop file system, so they hold on any storage Spark can write to, and both can be
run again after a crash at any step.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.operators.corrections import latest
from inkgrid.schemas import CORRECTIONS, TRANSCRIPTIONS
from inkgrid.session import remove_path

#: Requests to the file system at one time.
DELETES_AT_ONCE = 16


class Folder:
    """A folder, in the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self._fs.exists(self._place(self.path)):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._place(self.path)))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._place(f"{self.path}/{name}"))

    def remove(self, name: str) -> bool:
        return self._fs.delete(self._place(f"{self.path}/{name}"), True)

    def rename(self, name: str, to: str) -> None:
        if not self._fs.rename(self._place(f"{self.path}/{name}"), self._place(f"{self.path}/{to}")):
            raise OSError(f"{self.path}/{name} could not be renamed to {to}")


# --- transcriptions ------------------------------------------------------------------------------


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Transcriptions of a store, none of a store without any folder."""
    return spark.read.schema(f"{TRANSCRIPTIONS}, created_on DATE").parquet(path)


def remove_expired(spark: SparkSession, path: str, as_of: datetime, hours: int = fixed.RETENTION_HOURS) -> int:
    """Remove transcriptions created more than ``hours`` before ``as_of`` (UTC) from a store, with their source files.

    The store is what ``sinks.write_store`` writes: a folder for each day of creation, which bounds what is listed. Folders
    before the border day are dropped whole, unread but for ids and paths; only the border day is written anew. Returns how
    many transcriptions went.

    Order of work: source files, then old folders, then the border. Source files go first, so that no crash leaves a file
    that no row names; one that is already gone is no error. The border's rest is written aside and takes the folder's
    place by a rename; a run that finds the rest whole and the folder missing ends that step.
    """
    border = as_of - timedelta(hours=hours)
    day, folder = f"created_on={border:%Y-%m-%d}", Folder(spark, path)
    _end_rewrites(folder)
    days = [n for n in folder.names() if n.startswith("created_on=")]
    old, touched = [d for d in days if d < day], [d for d in days if d == day]
    if not old and not touched:
        return 0
    removed = 0
    gone = F.col("created_at") < F.lit(border)
    names = [n.removeprefix("created_on=") for n in old + touched]
    expired = read_store(spark, path).where(F.col("created_on").cast("string").isin(names) & gone)
    with ThreadPoolExecutor(DELETES_AT_ONCE) as pool:
        waiting = []
        # one partition of paths at a time comes to the driver, which alone may ask the file system to delete
        for row in expired.select("source_path").toLocalIterator():
            removed += 1
            if row["source_path"]:
                waiting.append(pool.submit(remove_path, spark, row["source_path"]))
            if len(waiting) >= 1024:
                for done in waiting:
                    done.result()
                waiting = []
        for done in waiting:
            done.result()
    for name in old:
        folder.remove(name)
    for name in touched:
        rows = spark.read.schema(TRANSCRIPTIONS).parquet(f"{path}/{name}")
        if rows.where(gone).limit(1).count():
            # no equals sign: only then does the underscore hide it from scans of the store
            rest = name.replace("created_on=", "_rest.")
            rows.where(~gone).write.mode("overwrite").parquet(f"{path}/{rest}")
            folder.remove(name)
            folder.rename(rest, name)
    return removed


def _end_rewrites(folder: Folder) -> None:
    """Put a written rest in its place if a crash came between removing the old folder and renaming the new one."""
    for rest in [n for n in folder.names() if n.startswith("_rest.")]:
        name = rest.replace("_rest.", "created_on=")
        if folder.has(f"{rest}/_SUCCESS") and not folder.has(name):
            folder.rename(rest, name)
        else:
            folder.remove(rest)


# --- corrections -----------------------------------------------------------------------------------

_SNAPSHOT = re.compile(r"_snapshot\.(\d+)$")
_BATCH = re.compile(r"batch=(\d+)$")


def _versions(folder: Folder) -> tuple[list[int], list[int]]:
    """Numbers of whole snapshots and of batches."""
    names = folder.names()
    whole = [int(m[1]) for n in names if (m := _SNAPSHOT.match(n)) and folder.has(f"{n}/_SUCCESS")]
    return sorted(whole), sorted(int(m[1]) for n in names if (m := _BATCH.match(n)))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """The last correction of each path of each document: the newest snapshot and the batches after it.

    A snapshot carries the number of the last batch it holds, so a batch written again after a failure counts once.
    """
    snapshots, batches = _versions(Folder(spark, path))
    newest = snapshots[-1] if snapshots else -1
    parts = [f"{path}/_snapshot.{newest}"] * bool(snapshots) + [f"{path}/batch={b}" for b in batches if b > newest]
    if not parts:
        return spark.createDataFrame([], CORRECTIONS)
    # each folder is a root of its own, so that its name adds no column
    frames = [spark.read.schema(CORRECTIONS).parquet(part) for part in parts]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return latest(whole)


def compact_corrections(spark: SparkSession, path: str) -> int | None:
    """Write a snapshot of the log up to its last batch and forget what the snapshot before it held.

    The switch is the marker that Spark writes last: until then readers see the old snapshot, afterwards the new one. What
    the previous snapshot was made of goes only now, a whole compaction later, so a reader that has already chosen its
    folders ends in peace. Returns the number of the batch, or None if there is nothing new.
    """
    folder = Folder(spark, path)
    snapshots, batches = _versions(folder)
    newest = snapshots[-1] if snapshots else -1
    last = max(batches, default=-1)
    if last <= newest:
        return None
    read_corrections(spark, path).write.mode("overwrite").parquet(f"{path}/_snapshot.{last}")
    for batch in batches:
        if batch <= newest:
            folder.remove(f"batch={batch}")
    for name in folder.names():
        made = _SNAPSHOT.match(name)
        if made and int(made[1]) not in (newest, last):
            folder.remove(name)
    return last

"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "inkgrid", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here relies on.

    ``master`` is only for tests and the bench; a cluster job leaves it to
    spark-submit, along with executor counts and memory.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where the job was submitted with the package in ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="inkgrid-ship-")) / "inkgrid.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, Path(root.name) / source.relative_to(root))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="inkgrid-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder, for plans that read it more than once.

    The files are on shared storage, so a lost executor costs only its own tasks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_bucketed(
    df: DataFrame, keys: tuple[str, ...], folders: str, buckets: int | None = None
) -> tuple[DataFrame, Callable[[], None]]:
    """Write ``df`` once beside the checkpoints, a folder per value of ``folders``, bucketed by ``keys`` within it.

    Reading a folder again keeps the partitioning by ``keys``: joins, windows and groups on them need no exchange. With as
    many buckets as shuffle partitions (the default), rows that come from an exchange on ``keys`` are written where they
    are. The second value drops the table and removes its files.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"inkgrid_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.partitionBy(folders).bucketBy(buckets, *keys)
    writer.format("parquet").option("path", path).saveAsTable(name)

    def release() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(spark, path)

    return spark.table(name), release


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder through the file system it lives in; False if it was not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

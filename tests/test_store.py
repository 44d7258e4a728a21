from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.sources import sinks, store

AS_OF = datetime(2024, 1, 3, 12)


@pytest.fixture
def filled(spark, tmp_path):
    """Four documents with uploads: two on old days, two around the border of the third."""
    born = {"old": "2024-01-01 01:00:00", "before": "2024-01-02 11:59:59", "edge": "2024-01-02 12:00:00", "new": "2024-01-03 00:00:00"}
    uploads = tmp_path / "uploads"
    uploads.mkdir()
    for name in born:
        (uploads / f"{name}.pdf").write_bytes(b"%PDF-")
    rows = [(name, fixed.DONE, f"file:{uploads}/{name}.pdf", t) for name, t in born.items()]
    rows.append(("nofile", fixed.FAILED, None, "2024-01-01 02:00:00"))
    df = spark.createDataFrame(rows, "id string, status string, source_path string, t string").select(
        "id", F.lit(fixed.TIMECARD).alias("doc_type"), "status", F.lit(None).cast("string").alias("error"),
        F.lit("{}").alias("value"), "source_path", F.col("t").cast("timestamp").alias("created_at"),
        F.col("t").cast("timestamp").alias("updated_at"),
    )
    path = str(tmp_path / "store")
    sinks.write_store(df, path)
    return path, uploads


def ids(spark, path):
    return sorted(r.id for r in store.read_store(spark, path).collect())


def test_expired_rows_and_files_are_gone(spark, filled):
    path, uploads = filled
    assert store.remove_expired(spark, path, AS_OF, 24) == 3
    assert ids(spark, path) == ["edge", "new"]
    assert sorted(p.name for p in uploads.iterdir()) == ["edge.pdf", "new.pdf"]
    assert store.remove_expired(spark, path, AS_OF, 24) == 0
    assert ids(spark, path) == ["edge", "new"]
    assert store.remove_expired(spark, path, datetime(2025, 1, 1), 24) == 2
    assert not list(uploads.iterdir()) and not store.Folder(spark, path).has("created_on=2024-01-03")
    assert store.remove_expired(spark, str(path) + "-missing", AS_OF) == 0


@pytest.mark.parametrize("step", ["remove", "rename", "remove_path"])
def test_a_run_after_a_crash_ends_the_work(spark, filled, monkeypatch, step):
    path, uploads = filled

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(*((store, step) if step == "remove_path" else (store.Folder, step)), crash)
        with pytest.raises(RuntimeError):
            store.remove_expired(spark, path, AS_OF, 24)
    store.remove_expired(spark, path, AS_OF, 24)
    assert ids(spark, path) == ["edge", "new"]
    assert sorted(p.name for p in uploads.iterdir()) == ["edge.pdf", "new.pdf"]


def edits(spark, *rows):
    return spark.createDataFrame([("d", *r) for r in rows], "doc_id string, path string, new_value string, t string").select(
        "doc_id", "path", "new_value", F.col("t").cast("timestamp").alias("ts"))


def test_log_of_corrections_is_compacted(spark, tmp_path):
    path = str(tmp_path / "log")

    def add(n, *rows):
        edits(spark, *rows).write.mode("overwrite").parquet(f"{path}/batch={n}")

    def now():
        return {r.path: r.new_value for r in store.read_corrections(spark, path).collect()}

    assert now() == {} and store.compact_corrections(spark, path) is None
    add(0, ("p", "1", "2024-01-01 00:00:00"), ("q", "old", "2024-01-05 00:00:00"))
    add(1, ("p", "2", "2024-01-02 00:00:00"), ("q", "late", "2024-01-04 00:00:00"))
    reader = store.read_corrections(spark, path)
    assert store.compact_corrections(spark, path) == 1 and store.compact_corrections(spark, path) is None
    # a reader from before the switch still has its folders
    assert {r.path: r.new_value for r in reader.collect()} == now() == {"p": "2", "q": "old"}
    # a batch that is written again after the switch counts once
    add(1, ("p", "2", "2024-01-02 00:00:00"), ("q", "late", "2024-01-04 00:00:00"))
    add(2, ("p", "3", "2024-01-03 00:00:00"))
    assert now() == {"p": "3", "q": "old"}
    assert store.compact_corrections(spark, path) == 2 and now() == {"p": "3", "q": "old"}
    assert not store.Folder(spark, path).has("batch=0") and store.Folder(spark, path).has("batch=2")
    # a snapshot without its marker is not there yet
    edits(spark, ("p", "wrong", "2030-01-01 00:00:00")).write.parquet(f"{path}/_snapshot.9")
    (tmp_path / "log" / "_snapshot.9" / "_SUCCESS").unlink()
    add(3, ("q", "new", "2024-02-01 00:00:00"))
    assert now() == {"p": "3", "q": "new"} and store.compact_corrections(spark, path) == 3
    assert now() == {"p": "3", "q": "new"} and not store.Folder(spark, path).has("_snapshot.9")

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid import fixed
from inkgrid.operators import grid
from inkgrid.plans import lifecycle, timecard
from inkgrid.schemas import OCR_ROWS
from inkgrid.sources import intake, sinks, values, words
from inkgrid.streaming import intake as streams
from tests.test_findings_grid import time_card


def test_recorded_pages_round_trip(spark, tmp_path):
    page = {"page": 1, "width": 595.0, "height": 842.0, "source": "ocr", "words": [
        {"text": "Olá", "x0": 1.0, "x1": 2.5, "top": 3.0, "bottom": 4.0, "confidence": 91.0}]}
    blank = {**page, "page": 2, "words": []}
    with gzip.open(tmp_path / "card-7.json.gz", "wt", encoding="utf-8") as f:
        json.dump([page, blank], f)
    read, pages = words.read_recorded(spark, str(tmp_path))
    assert [(r.doc_id, r.page, r.word_seq, r.text, r.confidence) for r in read.collect()] == [("card-7", 1, 0, "Olá", 91.0)]
    assert [r.n_words for r in words.words_per_page(read, pages).orderBy("page").collect()] == [1, 0]
    again = words.record_pages(read, pages).orderBy("page").collect()
    assert [len(r.words) for r in again] == [1, 0]


def test_ocr_rows(spark):
    rows = [
        ("d", 1, "baixa", "10", 300, 600, 30, 15, 300), ("d", 1, "bloco", "-1", 0, 0, 0, 0, 300),
        ("d", 1, " ", "90", 0, 0, 0, 0, 300), ("d", 1, "x", "nan?", 0, 0, 0, 0, 300),
    ]
    df = spark.createDataFrame(rows, OCR_ROWS).withColumn("word_seq", F.lit(0))
    got = words.ocr_words(df).collect()
    assert [(r.text, r.confidence, round(r.x0, 6), round(r.x1, 6), round(r.top, 6), round(r.bottom, 6)) for r in got] == [
        ("baixa", 10.0, 72.0, 79.2, 144.0, 147.6)
    ]


def test_source_choice_and_replacement(spark):
    native = spark.createDataFrame([("d", 1, i) for i in range(39)] + [("d", 2, i) for i in range(40)] + [("d", 3, 0)], "doc_id string, page int, word_seq int")
    pages = spark.createDataFrame([("d", k) for k in (1, 2, 3, 4)], "doc_id string, page int")
    chosen = words.choose_source(native, pages)
    assert [r.source for r in chosen.orderBy("page").collect()] == ["ocr", "texto_nativo", "ocr", "ocr"]
    ocr = spark.createDataFrame([("d", 1, 100), ("d", 2, 100)], "doc_id string, page int, word_seq int")
    out = words.replace_pages(native, ocr, pages.where("page < 3"), chosen)
    assert {r.page: r.n for r in out.groupBy("page").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 40, 3: 1}


def test_intake(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    (tmp_path / "c.pdf").write_bytes(b"")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    names = spark.createDataFrame([(f"file:{tmp_path}/{k}.pdf",) for k in "abcd"], "source_path string")
    files = intake.with_announced(intake.read_uploads(spark, str(tmp_path)), names).withColumn("n_pages", F.lit(51))
    got = {r.source_path[-5:]: r for r in intake.intake_verdict(files, max_bytes=50).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"a.pdf": "too_many_pages", "b.pdf": "not_pdf", "c.pdf": "empty", "d.pdf": "too_large"}
    assert got["a.pdf"].error == "O PDF tem 51 páginas e o limite é 50."
    closed = intake.intake_verdict(files.withColumn("n_pages", F.lit(None).cast("int")), max_bytes=50)
    assert {r.error for r in closed.where("verdict = 'unreadable'").collect()} == {"O PDF está corrompido ou não pôde ser aberto."}


def test_oversized_files_stay_closed(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "big.pdf").write_bytes(b"%PDF-" + b"x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # opening the large one would fail
    try:
        read = {r.length: r.head for r in intake.read_uploads(spark, str(tmp_path), max_bytes=50).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert read == {8: bytearray(b"%PDF-"), 5005: None}


def test_written_files(spark, tmp_path):
    days, punches = time_card(spark)
    lines = sinks.csv_lines(grid.timecard_grid(days, punches), ["page_pos", "day_pos"])
    sinks.export_csv(lines, ["page_pos", "day_pos"], str(tmp_path / "csv"), ["d"])
    sinks.write_csv(lines, ["page_pos", "day_pos"], str(tmp_path / "all"), folders=3)
    stored = [r.line for r in spark.read.parquet(str(tmp_path / "all")).orderBy("doc_id", "page_pos", "day_pos").collect()]
    assert [line.lstrip("\ufeff") for line in stored] == ["Data;Entrada 1;Saída 1", "21/05/2019;08:25;18:25", "25/05/2019;;"]
    parts = sorted((tmp_path / "csv" / "doc_id=d").glob("part-*"))
    text = b"".join(p.read_bytes() for p in parts).decode("utf-8")
    assert text == "﻿Data;Entrada 1;Saída 1\r\n21/05/2019;08:25;18:25\r\n25/05/2019;;\r\n"
    nested = days.select("doc_id", (F.col("page_pos") + 1).alias("page"), "day_pos", "date_raw",
        F.array().cast("array<struct<kind:string,time_raw:string,time_hhmm:string>>").alias("punches"))
    value = timecard.nest_timecards(nested, nested.select("doc_id", "page").distinct())
    sinks.export_json(value, str(tmp_path / "json"), ["d"])
    sinks.write_json(value, str(tmp_path / "all-json"), folders=3)
    assert json.loads(spark.read.parquet(str(tmp_path / "all-json")).first().json)["pages"][0]["page"] == 1
    written = next((tmp_path / "json" / "doc_id=d").glob("part-*")).read_text(encoding="utf-8")
    assert json.loads(written) == {"pages": [{"page": 1, "days": [
        {"date_raw": "21/05/2019", "punches": []}, {"date_raw": "25/05/2019", "punches": []}]}]}
    with pytest.raises(ValueError):
        sinks.file_name(F.lit("x"), "pdf")


def test_values_contract(spark):
    bad = '{"pages":[{"page":1,"days":[{"date_raw":null,"punches":[]},{"date_raw":"1","punches":[{"kind":"X","time_raw":"a","time_hhmm":"b"}]}]}]}'
    df = spark.createDataFrame([("d", bad)], "doc_id string, v string").select("doc_id", values.parse_timecard(F.col("v")).alias("value"))
    assert sorted(r.reason for r in values.timecard_violations(df).collect()) == ["date_raw missing", "kind unknown"]
    slip = '{"pages":[{"page":1,"year":"2020","month":"01","fields":[{"code":null,"label":"a","reference":"","value":"1,00"}],"bases":[]}]}'
    df = spark.createDataFrame([("d", slip)], "doc_id string, v string").select("doc_id", values.parse_payslip(F.col("v")).alias("value"))
    assert [r.reason for r in values.payslip_violations(df).collect()] == ["field text missing"]
    cases = {'{"pages":[{"page":1,"days":null}]}': ["days missing"], "{": ["value unreadable"], '{"pages":null}': ["value unreadable"],
             '{"pages":[]}': [], '{"pages":[{"page":1,"days":[]}]}': [], '{"pages":[null]}': ["page missing"]}
    for text, reasons in cases.items():
        df = spark.createDataFrame([("d", text)], "doc_id string, v string").select("doc_id", values.parse_timecard(F.col("v")).alias("value"))
        assert [r.reason for r in values.timecard_violations(df).collect()] == reasons
    for month, reasons in {"13": ["month unknown"], "00": ["month unknown"], "": [], "1?": [], "07": []}.items():
        text = slip.replace('"01"', f'"{month}"').replace("null", '"1"')
        df = spark.createDataFrame([("d", text)], "doc_id string, v string").select("doc_id", values.parse_payslip(F.col("v")).alias("value"))
        assert [r.reason for r in values.payslip_violations(df).collect()] == reasons


def test_retention_is_strict_and_by_creation(spark):
    rows = [("old", "2024-01-01 11:59:59"), ("edge", "2024-01-01 12:00:00"), ("new", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    kept, removed = lifecycle.expire(df, F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert [r.id for r in removed.collect()] == ["old"] and kept.count() == 2


def test_bounded_intake_stream_loses_none(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(5):
        (src / f"f{k}.pdf").write_bytes(b"%PDF-" if k else b"nope!")
    pages = [(f"file:{src}/f{k}.pdf", n) for k, n in enumerate([3, 3, 51, 0])]
    counts = spark.createDataFrame(pages, "source_path string, n_pages int")
    query = streams.run_intake(
        streams.upload_stream(spark, str(src), at_once=2), "salt", str(tmp_path / "out"), str(tmp_path / "cp"), counts
    )
    query.awaitTermination(120)
    assert query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 5 and {r.source_path[-5]: r.verdict for r in out.collect()} == {
        "0": "not_pdf", "1": None, "2": "too_many_pages", "3": "no_pages", "4": "unreadable",
    }
    assert out.select("batch").distinct().count() == 3
    assert out.select("doc_id").distinct().count() == 5


def test_state_of_the_intake_has_few_parts(spark, tmp_path):
    rows = [(f"/up/{k}.pdf", 5, bytearray(b"%PDF-"), "2024-01-01 00:00:00") for k in range(6)]
    files = spark.createDataFrame(rows, "source_path string, length bigint, head binary, t string")
    named = files.select("source_path", "length", "head", F.col("t").cast("timestamp").alias("created_at"))
    named.write.parquet(str(tmp_path / "in"))
    counts = named.select("source_path", F.lit(1).alias("n_pages"))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        uploads = spark.readStream.schema(named.schema).parquet(str(tmp_path / "in"))
        streams.run_intake(uploads, "salt", str(tmp_path / "out"), str(tmp_path / "cp"), counts).awaitTermination(120)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert len([p for p in (tmp_path / "cp" / "state" / "0").iterdir() if p.name.isdigit()]) == 4
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_life_log_stream(spark, tmp_path):
    rows = [
        ("a", 0, fixed.TIMECARD, "received", None, "2024-01-01 00:00:00"), ("a", 1, fixed.TIMECARD, "done", "{}", "2024-01-01 00:01:00"),
        ("b", 0, fixed.PAYSLIP, "received", None, "2024-01-01 00:00:00"), ("b", 1, fixed.PAYSLIP, "failure", None, "2024-01-01 00:02:00"),
        ("c", 0, fixed.PAYSLIP, "received", None, "2024-01-01 00:00:00"),
    ]
    log = spark.createDataFrame(rows, "id string, seq bigint, doc_type string, event string, value string, t string")
    log.select("id", "seq", "doc_type", "event", "value", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(streams.LOG).parquet(str(tmp_path / "in"))
    query = streams.run_log(events, str(tmp_path / "log"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    state = {r.id: (r.status, r.error, r.value) for r in streams.current_state(spark, str(tmp_path / "log")).collect()}
    assert state == {
        "a": (fixed.DONE, None, "{}"), "b": (fixed.FAILED, fixed.MSG_FAILURE, None), "c": (fixed.PROCESSING, None, None),
    }


def test_corrections_stream(spark, tmp_path):
    rows = [("d", "p", "1", "2024-01-01 00:00:00"), ("d", "p", "2", "2024-01-02 00:00:00"), ("d", "q", "3", "2024-01-01 00:00:00")]
    src = spark.createDataFrame(rows, "doc_id string, path string, new_value string, t string").select(
        "doc_id", "path", "new_value", F.col("t").cast("timestamp").alias("ts"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    query = streams.run_corrections(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.path, r.new_value) for r in out.collect()) == [("p", "2"), ("q", "3")]


def test_json_layout_equals_the_standard_one(spark):
    schema = (
        "value struct<pages: array<struct<page: int, `rótulo`: string, ok: boolean, n: bigint, items: array<string>,"
        " more: struct<a: array<struct<b: string>>>>>, none: array<int>>"
    )
    texts = ["", 'aspas " e \\ barra', "linha\nnova\ttab\r\b\f", "ção € \U0001d11e", "/", "a,b: {[]}", "\x01", None]
    page = lambda n: {"page": n, "rótulo": texts[n % 8], "ok": n % 2 == 0, "n": None, "items": texts[: n % 9], "more": {"a": [{"b": t} for t in texts[:n % 3]]}}
    rows = [{"pages": [page(n) for n in range(k)], "none": None if k % 2 else []} for k in range(12)]
    frame = spark.createDataFrame([(r,) for r in rows], schema)
    got = [r.json for r in frame.select(values.json_layout(F.col("value"), frame.schema["value"].dataType).alias("json")).collect()]
    assert got == [json.dumps(r, indent=2, ensure_ascii=False) for r in rows]
    with pytest.raises(TypeError, match="double"):
        values.json_layout(F.lit(1.0), T.DoubleType())


def test_replaced_pages_are_hashed_and_words_never_sorted(spark):
    native = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc_id string, page int, text string")
    delivered = native.select("doc_id", "page")
    chosen = delivered.withColumn("source", F.lit(fixed.OCR))
    ocr = native.withColumn("text", F.upper("text"))
    out = words.replace_pages(native, ocr, delivered.unionByName(delivered).where("page = 2"), chosen.unionByName(chosen))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin [doc_id") == 2
    assert sorted((r.page, r.text) for r in out.collect()) == [(1, "a"), (2, "B")]

"""Schemas of stored tables and of nested values, as DDL."""

WORDS = (
    "doc_id STRING, page INT, word_seq INT, text STRING, x0 DOUBLE, x1 DOUBLE,"
    " top DOUBLE, bottom DOUBLE, confidence DOUBLE"
)
PAGES = "doc_id STRING, page INT, width DOUBLE, height DOUBLE, source STRING"
OCR_ROWS = (
    "doc_id STRING, page INT, text STRING, conf STRING, `left` INT, top INT,"
    " width INT, height INT, dpi INT"
)
RECORDED_WORDS = (
    "ARRAY<STRUCT<text: STRING, x0: DOUBLE, x1: DOUBLE, top: DOUBLE, bottom: DOUBLE,"
    " confidence: DOUBLE>>"
)
RECORDED_PAGE = (
    f"page INT, width DOUBLE, height DOUBLE, source STRING, words {RECORDED_WORDS}"
)
PUNCH = "STRUCT<kind: STRING, time_raw: STRING, time_hhmm: STRING>"
DAY = f"STRUCT<date_raw: STRING, punches: ARRAY<{PUNCH}>>"
PAY_FIELD = "STRUCT<code: STRING, label: STRING, reference: STRING, value: STRING>"
PAY_BASE = "STRUCT<label: STRING, value: STRING>"
TIMECARD_VALUE = f"pages ARRAY<STRUCT<page: INT, days: ARRAY<{DAY}>>>"
PAYSLIP_VALUE = (
    "pages ARRAY<STRUCT<page: INT, year: STRING, month: STRING,"
    f" fields: ARRAY<{PAY_FIELD}>, bases: ARRAY<{PAY_BASE}>>>"
)
TRANSCRIPTIONS = (
    "id STRING, doc_type STRING, status STRING, error STRING, value STRING,"
    " source_path STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
CORRECTIONS = "doc_id STRING, path STRING, new_value STRING, ts TIMESTAMP"

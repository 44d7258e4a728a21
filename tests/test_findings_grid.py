from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.operators import corrections, findings, grid
from inkgrid.operators.scans import carry_last, dense_position, explode_span, salted_join
from inkgrid.sources import sinks

DAYS = "doc_id string, page_pos int, day_pos int, date_raw string, n_punches int, marked boolean"


def day_codes(spark, *rows):
    """rows: (date_raw, n_punches[, marked]); one document, pages of two days."""
    data = [("d", i // 2, i % 2, r[0], r[1], r[2] if len(r) > 2 else "?" in r[0]) for i, r in enumerate(rows)]
    out = findings.timecard_findings(spark.createDataFrame(data, DAYS))
    got = out.orderBy("page_pos", "day_pos").collect()
    return [(list(r.codes), r.severity) for r in got]


ODD, BREAK, UNSURE = fixed.ODD_PUNCHES[0], fixed.DATE_BREAK[0], fixed.UNCERTAIN[0]


def test_time_card_findings(spark):
    none = ([], None)
    assert day_codes(spark, ("21/05/2019", 3), ("22/05/2019", 4), ("23/05/2019", 0)) == [([ODD], "amarelo"), none, none]
    assert day_codes(spark, ("30/04/2019", 0), ("01/05/2019", 0), ("02/05/2019", 0)) == [none] * 3
    assert day_codes(spark, ("01/05/2019", 0), ("05/05/2019", 0))[1] == ([BREAK], "vermelho")
    assert [c for c, _ in day_codes(spark, ("01/07/2019", 0), ("38/07/2019", 0), ("03/07/2019", 0))] == [[], [BREAK], [BREAK]]
    assert [c for c, _ in day_codes(spark, ("01/07/2019", 0), ("0?/07/2019", 0), ("02/07/2019", 0))] == [[], [UNSURE], []]
    assert day_codes(spark, ("01/05/2019", 0), ("09/05/2019", 1))[1] == ([ODD, BREAK], "vermelho")
    assert day_codes(spark, ("5", 0), ("7", 2, True)) == [none, ([UNSURE], "amarelo")]


def month_codes(spark, *rows):
    """rows: (month, year, n_fields, n_bases, marked)"""
    data = [("d", i, r[1], r[0], r[2], r[3], r[4]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(
        data, "doc_id string, entry_pos int, year string, month string, n_fields int, n_bases int, marked boolean"
    )
    return [list(r.codes) for r in findings.payslip_findings(df).orderBy("entry_pos").collect()]


def test_payslip_findings(spark):
    m = lambda month, year: (month, year, 1, 1, False)
    broken = [fixed.MONTH_BREAK[0]]
    assert month_codes(spark, m("10", "2019"), m("11", "2019")) == [[], []]
    assert month_codes(spark, m("12", "2019"), m("01", "2020")) == [[], []]
    assert month_codes(spark, m("12", "2019"), m("01", "2019")) == [[], broken]
    assert month_codes(spark, m("01", "2020"), m("03", "2020")) == [[], broken]
    assert month_codes(spark, m("03", "2020"), m("", ""), m("04", "2020")) == [[], [], []]
    assert month_codes(spark, m("03", "2020"), m("13", "2020"), m("04", "2020")) == [[], [], []]
    assert month_codes(spark, ("01", "2020", 0, 0, False), ("02", "2020", 0, 1, True)) == [
        [fixed.EMPTY_PAGE[0]], [UNSURE],
    ]


def test_scans_equal_brute_force_with_one_large_group(spark):
    import random

    rng = random.Random(5)
    rows, want_last, want_pos = [], {}, {}
    for doc, size in (("big", 600), ("a", 7), ("b", 1)):
        last = None
        for i in range(size):
            v = rng.randrange(100) if rng.random() < 0.2 else None
            rows.append((doc, i, v))
            want_last[doc, i], want_pos[doc, i] = last, i
            last = v if v is not None else last
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, i int, v int")
    chunk = F.floor(F.col("i") / 50)
    got = carry_last(df, ["doc_id"], ["i"], chunk, "v", "prev").collect()
    assert {(r.doc_id, r.i): r.prev for r in got} == want_last
    got = dense_position(df, ["doc_id"], ["i"], chunk, "pos").collect()
    assert {(r.doc_id, r.i): r.pos for r in got} == want_pos


def test_salted_join_and_spans(spark):
    left = spark.createDataFrame([("k", i) for i in range(40)] + [("z", 1)], "k string, i int")
    right = spark.createDataFrame([("k", "x"), ("k", "y")], "k string, v string")
    assert salted_join(left, right, ["k"], F.col("i"), 4).count() == 80
    spans = spark.createDataFrame([(1, 5), (3, 2), (7, 7)], "a int, b int")
    got = explode_span(spans, F.col("a"), F.col("b"), "n", step=2).collect()
    assert sorted((r.a, r.n) for r in got) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (7, 7)]


def time_card(spark):
    days = spark.createDataFrame(
        [("d", 0, 0, "21/05/2019", 2, False), ("d", 0, 1, "25/05/2019", 0, False)], DAYS
    )
    punches = spark.createDataFrame(
        [("d", 0, 0, 0, "IN", "08:25", "08:25"), ("d", 0, 0, 1, "OUT", "18:2?", "18:25")],
        "doc_id string, page_pos int, day_pos int, punch_pos int, kind string, time_raw string, time_hhmm string",
    )
    return days, punches


def test_time_card_sheet(spark):
    days, punches = time_card(spark)
    cells = grid.timecard_grid(days, punches)
    lines = sinks.csv_lines(cells, ["page_pos", "day_pos"]).orderBy("page_pos", "day_pos").collect()
    assert [r.line for r in lines] == [
        "﻿Data;Entrada 1;Saída 1", "21/05/2019;08:25;18:25", "25/05/2019;;",
    ]
    review = grid.assert_in_step(
        grid.review_rows(cells, findings.timecard_findings(days), ["page_pos", "day_pos"])
    ).orderBy("day_pos").collect()
    assert review[0].cells[1].path == "pages.0.days.0.punches.0.time_hhmm"
    assert [c.path for c in review[1].cells] == ["pages.0.days.1.date_raw", "", ""]
    assert review[1].severity == "vermelho"
    assert grid.unmatched_rows(grid.review_rows(cells, findings.timecard_findings(days.limit(1)), ["page_pos", "day_pos"])).count() == 1


def test_corrections_reach_the_sheet(spark):
    days, punches = time_card(spark)
    edits = spark.createDataFrame(
        [
            ("d", "pages.0.days.0.punches.0.time_hhmm", "07:00", "2024-01-01 00:00:00"),
            ("d", "pages.0.days.0.punches.0.time_hhmm", "07:15", "2024-01-02 00:00:00"),
            ("d", "pages.0.days.1.date_raw", "22/05/2019", "2024-01-02 00:00:00"),
            ("d", "pages.0.days.9.date_raw", "x", "2024-01-02 00:00:00"),
            ("d", "pages.0.page", "x", "2024-01-02 00:00:00"),
        ],
        "doc_id string, path string, new_value string, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    new_days, new_punches = corrections.correct_timecards(days, punches, edits)
    got = new_punches.orderBy("punch_pos").collect()
    assert (got[0].time_hhmm, got[0].time_raw) == ("07:15", "08:25")
    assert [r.severity for r in findings.timecard_findings(new_days).orderBy("day_pos").collect()] == [None, None]
    marked = findings.summarise_days(new_days.select("doc_id", "page_pos", "day_pos", "date_raw"), new_punches)
    assert [r.marked for r in marked.orderBy("day_pos").collect()] == [True, False]
    rejected = corrections.rejected_corrections(edits, corrections.timecard_paths(days, punches))
    assert {r.path for r in rejected.collect()} == {"pages.0.days.9.date_raw", "pages.0.page"}


def test_payslip_sheet(spark):
    entries = spark.createDataFrame(
        [("d", 0, 1, "01", "2020"), ("d", 1, 2, "02", "2020")],
        "doc_id string, entry_pos int, page int, month string, year string",
    )
    fields = spark.createDataFrame(
        [
            ("d", 0, 0, "Salário Base", "2.389,77"), ("d", 0, 1, "INSS", "262,87"), ("d", 0, 2, "INSS", "1,00"),
            ("d", 1, 0, 'Horas "Extras"; 50%', "155,91"),
        ],
        "doc_id string, entry_pos int, field_pos int, label string, value string",
    ).selectExpr("*", "'' AS code", "'' AS reference")
    cells = grid.payslip_grid(entries, fields)
    lines = sinks.csv_lines(cells, ["entry_pos"]).orderBy("entry_pos").collect()
    assert [r.line for r in lines] == [
        '﻿Pág.;Mês;Ano;Salário Base;INSS;"Horas ""Extras""; 50%"',
        "1;01;2020;2.389,77;262,87;", "2;02;2020;;;155,91",
    ]
    paths = {(r.entry_pos, r.col_pos): r.path for r in cells.collect()}
    assert paths[0, 0] == "" and paths[0, 4] == "pages.0.fields.1.value" and paths[1, 3] == ""
    edits = spark.createDataFrame(
        [("d", "pages.1.fields.0.value", "9,99"), ("d", "pages.0.month", "12")], "doc_id string, path string, new_value string"
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    bases = spark.createDataFrame([("d", 0, 0, "Base INSS", "1,00")], "doc_id string, entry_pos int, base_pos int, label string, value string")
    edits = edits.unionByName(edits.limit(1).selectExpr("doc_id", "'pages.0.bases.0.value' AS path", "'2,00' AS new_value", "ts"))
    edits = edits.unionByName(edits.limit(1).selectExpr("doc_id", "'pages.0.bases.1.value' AS path", "'3,00' AS new_value", "ts"))
    new_entries, new_fields, new_bases = corrections.correct_payslips(entries, fields, bases, edits)
    assert [r.value for r in new_bases.collect()] == ["2,00"]
    lost = corrections.rejected_corrections(edits, corrections.payslip_paths(entries, fields, bases))
    assert [r.path for r in lost.collect()] == ["pages.0.bases.1.value"]
    assert new_entries.where("entry_pos = 0").first().month == "12"
    assert new_fields.where("entry_pos = 1").first().value == "9,99"


def test_widths_and_styles(spark):
    days, punches = time_card(spark)
    widths = {r.col_pos: r.width for r in grid.column_widths(grid.timecard_grid(days, punches)).collect()}
    assert widths == {0: 12, 1: 11, 2: 9}
    styled = findings.severity_style(findings.timecard_findings(days)).orderBy("day_pos").collect()
    assert [(r.fill, r.left_border) for r in styled] == [(None, None), ("F8D7DA", "DC3545")]
    head = sinks.styled_header(grid.timecard_grid(days, punches)).first()
    assert (head.fill, head.font_color) == ("173772", "FFFFFF")


def test_sheet_from_one_scan_equals_sheet_joined_with_findings(spark):
    import random

    from pyspark.sql import Row

    from inkgrid.plans import timecard

    rng = random.Random(11)
    days = []
    for doc, pages in (("big", 150), ("small", 2), ("bare", 1)):
        for page in range(1, pages + 1):
            for k in range(rng.randint(1, 3)):
                date = rng.choice(["01/01/2024", "02/01/2024", "0?/01/2024", "38/01/2024", "x"])
                n = 0 if doc == "bare" else rng.randint(0, 5)
                days.append(Row(doc_id=doc, page=page, day_pos=k, date_raw=date, punches=[
                    Row(kind="IN", time_raw="08:00", time_hhmm=rng.choice(["08:00", "0?:00"])) for _ in range(n)]))
    schema = "doc_id string, page int, day_pos int, date_raw string, punches array<struct<kind:string,time_raw:string,time_hhmm:string>>"
    nested = spark.createDataFrame(days, schema)
    flat = findings.summarise_nested_days(nested)
    punches = timecard.flat_punches(nested).withColumn("page_pos", F.col("page") - 1)
    cells = grid.timecard_grid(flat, punches)
    joined = grid.assert_in_step(grid.review_rows(cells, findings.timecard_findings(flat), ["page_pos", "day_pos"]))
    names = ["doc_id", "page_pos", "day_pos", "cells", "codes", "reasons", "severity"]
    sheet = grid.timecard_sheet(nested)
    assert sorted(map(str, sheet.select(names).collect())) == sorted(map(str, joined.select(names).collect()))
    lines = sinks.csv_lines(cells, ["page_pos", "day_pos"])
    assert sorted(map(str, sinks.sheet_csv_lines(sheet).collect())) == sorted(map(str, lines.collect()))
    plan = sheet._jdf.queryExecution().executedPlan().toString()
    assert sheet.select("doc_id").count() == len(days) and plan.count("Scan ExistingRDD") <= 2


def test_scans_of_scans_and_with_themselves(spark):
    rows = spark.range(500).select(F.lit("a").alias("g"), F.col("id").alias("o"))
    once = dense_position(rows, ["g"], ["o"], F.floor(F.col("o") / 64), "p")
    again = dense_position(once, ["g"], ["p"], F.floor(F.col("p") / 64), "q")
    assert [tuple(r) for r in again.where("o IN (0, 77, 499)").select("o", "p", "q").orderBy("o").collect()] == [
        (0, 0, 0), (77, 77, 77), (499, 499, 499)]
    assert again.join(again.groupBy("g").agg(F.max("q").alias("m")), "g").where("m = 499").count() == 500

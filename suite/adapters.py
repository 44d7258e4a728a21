"""Engine inputs derived from the driver tables, all deterministic.

``A`` adapters reshape tables directly. ``render_*`` set each row as printed
lines of a page in one of the seven layouts, so that the readers can be checked
against the values the row was printed from. Document, page and place of a row
are functions of its key: every rendered document has a fixed number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.functions.tokens import is_money, read_clock, read_money
from inkgrid.operators.scans import dense_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- small helpers -----------------------------------------------------------


def brl(cents: Column) -> Column:
    """Integer cents as a Brazilian amount."""
    whole = F.replace(F.format_number(F.floor(cents / 100), 0), F.lit(","), F.lit("."))
    return F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def damage(text: Column, hit: Column, mark: str) -> Column:
    """Last character replaced when ``hit``."""
    return F.when(hit, F.concat(F.substr(text, F.lit(1), F.char_length(text) - 1), F.lit(mark))).otherwise(text)


def pad2(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def mod(col: Column, n: int, *values: int) -> Column:
    return (col % n).isin(*(values or (0,)))


# --- A1: words and pages of documents ----------------------------------------


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.split("text", r"\s+").alias("tokens")
    )


def a1_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve words a line, fifty lines a page, with a baseline that wavers."""
    i = F.col("i")
    line = F.floor(i / 12).cast("int")
    top = 14.0 * (line % 50) + 0.5 * (i % 3)
    x0 = 40.0 * (i % 12)
    return (
        document_tokens(spark, sf_dir)
        .select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode("tokens").alias("i", "text"))
        .where("text != ''")
        .select(
            "doc_id",
            (line / 50).cast("int").alias("page0"),
            F.col("i").alias("word_seq"),
            "text",
            x0.alias("x0"),
            (x0 + 5.0 * F.char_length("text")).alias("x1"),
            top.alias("top"),
            (top + 8.0 + (i % 5)).alias("bottom"),
        )
        .withColumn("page", F.col("page0") + 1)
        .drop("page0")
    )


def a1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the documents; every seventh document ends with a blank one."""
    n = F.ceil(F.size("tokens") / 600).cast("int") + F.when(mod(F.col("doc_id"), 7), 1).otherwise(0)
    return document_tokens(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.explode(F.sequence(F.lit(1), n)).alias("page"),
        F.lit(600.0).alias("width"),
        F.lit(842.0).alias("height"),
        F.lit(fixed.NATIVE).alias("source"),
    )


# --- A2: punch log of events ---------------------------------------------------


def a2_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: the clock as printed, with damaged and suffixed ones."""
    e = F.col("event_id")
    clock = F.date_format("ts", "HH:mm")
    token = (
        F.when(e % 53 == 0, F.concat(F.lit("O"), F.substr(clock, F.lit(2))))
        .when(e % 97 == 0, F.concat(clock, F.lit("€")))
        .when(e % 5 == 0, F.concat(clock, F.lit("d")))
        .otherwise(clock)
    )
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("doc_id"),
        ((F.year("ts") - 2024) * 12 + F.month("ts") - 1).alias("page_pos"),
        day.alias("day"),
        "ts",
        "event_id",
        token.alias("token"),
    )


def a2_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each user in calendar order; a page is a month."""
    seen = a2_log(spark, sf_dir).groupBy("doc_id", "page_pos", "day").agg(
        F.min("event_id").alias("first_event")
    )
    day_pos = F.dayofmonth("day") - 1
    text = F.date_format("day", "dd/MM/yyyy")
    return seen.select(
        "doc_id",
        "page_pos",
        day_pos.alias("day_pos"),
        F.when(F.col("first_event") % 61 == 0, F.concat(F.lit("?"), F.substr(text, F.lit(2))))
        .otherwise(text)
        .alias("date_raw"),
    )


def a2_punches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punches in order of time. A day of a busy user is ranked minute by minute."""
    log = a2_log(spark, sf_dir).withColumn("day_pos", F.dayofmonth("day") - 1)
    minute = F.hour("ts") * 60 + F.minute("ts")
    placed = dense_position(
        log, ["doc_id", "page_pos", "day_pos"], ["ts", "event_id"], minute, "punch_pos"
    )
    clock = read_clock(F.col("token"))
    return placed.select(
        "doc_id",
        "page_pos",
        "day_pos",
        "punch_pos",
        F.when(F.col("punch_pos") % 2 == 0, F.lit("IN")).otherwise(F.lit("OUT")).alias("kind"),
        clock["raw"].alias("time_raw"),
        clock["norm"].alias("time_hhmm"),
    )


# --- A3: pay tables of orders --------------------------------------------------


def a3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as entries, by date; the chunk of the ranking is the month."""
    o = table(spark, sf_dir, "orders")
    dated = o.select(
        F.col("o_custkey").cast("string").alias("doc_id"),
        "o_orderkey",
        F.col("o_orderdate").alias("at"),
        F.when(mod(F.col("o_orderkey"), 23), F.lit("?2")).otherwise(pad2(F.month("o_orderdate"))).alias("month"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.when(~mod(F.col("o_orderkey"), 29), brl(F.round(F.col("o_totalprice") * 100).cast("bigint"))).alias("total"),
    )
    month = F.year("at") * 12 + F.month("at")
    return dense_position(dated, ["doc_id"], ["at", "o_orderkey"], month, "entry_pos").select(
        "doc_id", "entry_pos", (F.col("entry_pos") + 1).alias("page"), "month", "year", "total", "o_orderkey"
    )


def a3_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part type, before the order is known."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    amount = brl(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        F.lpad(F.col("l_linenumber").cast("string"), 4, "0").alias("code"),
        F.col("p_type").alias("label"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",00")).alias("reference"),
        damage(amount, mod(F.col("l_orderkey"), 41), "?").alias("value"),
    )


def a3_fields(spark: SparkSession, sf_dir: str, entries: DataFrame | None = None) -> DataFrame:
    entries = a3_entries(spark, sf_dir) if entries is None else entries
    placed = dense_position(
        a3_field_values(spark, sf_dir),
        ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"],
        F.col("l_linenumber"),
        "field_pos",
    )
    keys = entries.select("doc_id", "entry_pos", F.col("o_orderkey").alias("l_orderkey"))
    return placed.join(keys, "l_orderkey").select(
        "doc_id", "entry_pos", "field_pos", "code", "label", "reference", "value"
    )


def a3_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of an order as its only base, where it is printed."""
    e = a3_entries(spark, sf_dir).where("total IS NOT NULL")
    return e.select("doc_id", "entry_pos", F.lit(0).alias("base_pos"), F.lit("Total").alias("label"), F.col("total").alias("value"))


def a3_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction for each entry, of each kind of path; some name nothing, some are corrected again later."""
    e = F.col("o_orderkey")
    root = F.concat(F.lit("pages."), F.col("entry_pos"))
    path = (
        F.when(e % 6 == 0, F.concat(root, F.lit(".month")))
        .when(e % 6 == 1, F.concat(root, F.lit(".year")))
        .when(e % 6 == 2, F.concat(root, F.lit(".bases.0.value")))
        .when(e % 6 == 3, F.concat(root, F.lit(".fields."), e % 5, F.lit(".value")))
        .when(e % 6 == 4, F.concat(root, F.lit(".bases.3.label")))
        .otherwise(F.concat(root, F.lit(".fields.0.colour")))
    )
    first = (
        F.when(e % 6 == 0, pad2(e % 12 + 1)).when(e % 6 == 1, (2000 + e % 9).cast("string")).otherwise(brl(e))
    )
    edits = a3_entries(spark, sf_dir).select("doc_id", path.alias("path"), first.alias("new_value"), "o_orderkey")
    again = edits.where("o_orderkey % 4 = 0").withColumn("new_value", F.lit("?"))
    return edits.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).unionByName(
        again.withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    ).drop("o_orderkey")


def a3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat entries with counts and mark: what the findings need."""
    lines = a3_field_values(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.bool_or(F.contains("value", F.lit("?"))).alias("m")
    )
    return a3_entries(spark, sf_dir).join(lines, "o_orderkey", "left").select(
        "doc_id",
        "entry_pos",
        "year",
        "month",
        F.coalesce("n", F.lit(0)).cast("int").alias("n_fields"),
        F.when(F.col("total").isNull(), 0).otherwise(1).alias("n_bases"),
        (F.contains("month", F.lit("?")) | F.coalesce("m", F.lit(False))).alias("marked"),
    )


# --- A4: lifecycle of events -----------------------------------------------------


def a4_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = (
        F.when(kind.isin("signup", "click"), F.lit("received"))
        .when(kind == "purchase", F.lit("done"))
        .when(kind == "view", F.lit("unknown_layout"))
        .otherwise(F.lit("failure"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_id").alias("seq"),
        F.when(mod(F.col("user_id"), 2), F.lit(fixed.TIMECARD)).otherwise(F.lit(fixed.PAYSLIP)).alias("doc_type"),
        event.alias("event"),
        F.when(event == "done", F.col("props")).alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def a4_transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per event, in the state its type gives."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(mod(F.col("user_id"), 2), F.lit(fixed.TIMECARD)).otherwise(F.lit(fixed.PAYSLIP)).alias("doc_type"),
        F.when(kind.isin("signup", "click"), F.lit(fixed.PROCESSING))
        .when(kind == "purchase", F.lit(fixed.DONE))
        .otherwise(F.lit(fixed.FAILED))
        .alias("status"),
        F.when(kind == "view", F.lit(fixed.MSG_UNKNOWN_LAYOUT))
        .when(kind == "error", F.lit(fixed.MSG_FAILURE))
        .alias("error"),
        F.when(~mod(F.col("event_id"), 10), F.col("props")).alias("value"),
        F.concat(F.lit("/uploads/"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("source_path"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )


# --- A5: uploads of web pages ------------------------------------------------------


def a5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    content = F.encode(
        F.when(mod(p, 10), F.lit("")).when(mod(p, 3), F.col("html")).otherwise(F.concat(F.lit("%PDF-"), F.col("html"))),
        "utf-8",
    )
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("doc_id"),
        F.col("url").alias("source_path"),
        F.octet_length(content).cast("bigint").alias("length"),
        F.substring(content, 1, 5).alias("head"),
        F.when(p % 60 != 7, (p % 60).cast("int")).alias("n_pages"),
    )


# --- A6: lines of tokens with labels and amounts -----------------------------------


def a6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve tokens a line; every fifth token ends a label, every sixth is an amount."""
    numbers = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / 12).cast("int"))
    lines = document_tokens(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.posexplode(F.transform(numbers, lambda n: F.slice("tokens", n * 12 + 1, F.lit(12)))).alias("line_no", "part"),
    )

    def token(text: Column, k: Column) -> Column:
        i = F.col("line_no") * 12 + k
        return (
            F.when(i % 6 == 0, brl(i.cast("bigint") * 137))
            .when(i % 5 == 4, F.concat(F.regexp_replace(text, ":+$", ""), F.lit(":")))
            .otherwise(F.regexp_replace(text, "[:,]+$", ""))
        )

    return lines.select(
        "doc_id",
        "line_no",
        F.filter(F.transform("part", token), lambda t: t != "").alias("texts"),
    )


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tokens a line; the binary digits of the line number say which of them are amounts."""
    numbers = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / 5).cast("int"))
    lines = document_tokens(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.posexplode(F.transform(numbers, lambda n: F.slice("tokens", n * 5 + 1, F.lit(5)))).alias("line_no", "part"),
    )
    number = F.col("line_no").cast("bigint")
    digit = lambda k: F.substr(F.lpad(F.bin(number % 32), 5, "0"), 5 - k, F.lit(1))
    token = lambda text, k: F.when(digit(k) == "1", brl((number * 5 + k) * 137)).otherwise(text)
    return lines.select("doc_id", "line_no", F.transform("part", token).alias("texts"))


# --- rendering -----------------------------------------------------------------


def _w(text, x0: float) -> Column:
    col = text if isinstance(text, Column) else F.lit(text)
    return F.struct(col.alias("text"), F.lit(float(x0)).alias("x0"))


def _row(top: Column | float, *words: Column) -> Column:
    y = top if isinstance(top, Column) else F.lit(float(top))
    return F.transform(
        F.array(*words),
        lambda w: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), y.cast("double").alias("top")),
    )


def _run(top, *texts, x0: float = 10.0, step: float = 90.0) -> Column:
    """Words on a line at even steps."""
    return _row(top, *[_w(t, x0 + k * step) for k, t in enumerate(texts)])


def _titles(top, titles, xs) -> Column:
    return _row(top, *[_w(t, x) for t, x in zip(titles, xs)])


def _printed(df: DataFrame, lines: list[Column], base_seq: Column) -> DataFrame:
    words = F.filter(F.concat(*lines), lambda w: w["text"].isNotNull() & (w["text"] != ""))
    return df.select(
        "doc_id", "page", base_seq.alias("_s"), F.posexplode(words).alias("_k", "w")
    ).select(
        "doc_id",
        "page",
        (F.col("_s") * 1000 + F.col("_k")).cast("int").alias("word_seq"),
        "w.text",
        "w.x0",
        (F.col("w.x0") + 5.0 * F.char_length("w.text")).alias("x1"),
        "w.top",
        (F.col("w.top") + 10.0).alias("bottom"),
    )


def _pages_of(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.groupBy("doc_id", "page", *keep).agg(F.count("*").alias("rows"))


def _page_table(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "page").distinct().select(
        "doc_id",
        "page",
        F.lit(640.0).alias("width"),
        F.lit(1200.0).alias("height"),
        F.lit(fixed.OCR).alias("source"),
    )


def _assemble(rows: DataFrame, head: list[Column], body: list[Column], place: Column, *keep: str):
    """Words and pages: a heading per page, then the lines of each row."""
    headings = _printed(_pages_of(rows, *keep), head, F.lit(0))
    return headings.unionByName(_printed(rows, body, place + 1)), _page_table(rows)


#: Rows of a table set as pages by one task: each grows to some hundred words.
_ROWS_PER_TASK = 25_000


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows in as many ranges of the key as their number asks for: a table of few files is set by few tasks else."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // _ROWS_PER_TASK))
    return rows.repartitionByRange(parts, key)


def _event_rows(spark, sf_dir, letter: str, per_doc: int, per_page: int) -> DataFrame:
    e = F.col("e")
    return _dealt(table(spark, sf_dir, "events").select(
        F.col("event_id").alias("e"), pad2(F.minute("ts")).alias("mm")
    ), "e").select(
        "e",
        "mm",
        F.floor(e / per_doc).alias("docno"),
        F.concat(F.lit(letter), F.floor(e / per_doc).cast("string")).alias("doc_id"),
        (F.floor((e % per_doc) / per_page) + 1).cast("int").alias("page"),
        (e % per_page).cast("int").alias("r"),
    )


def _hm(hour: int) -> Column:
    return F.concat(F.lit(f"{hour:02d}:"), F.col("mm"))


def render_tabular(spark: SparkSession, sf_dir: str):
    rows = _event_rows(spark, sf_dir, "T", 90, 30)
    e, top = F.col("e"), 70 + 14 * F.col("r")
    xs = [15, 95, 131, 184, 220, 256, 292, 328, 364, 400, 440, 480, 520, 580]
    titled = ~(mod(F.col("docno"), 11) & (F.col("page") == 2))
    read = list(fixed.TITLES_TABULAR)
    read[1], read[2], read[4] = "Entl", "Sail", "Sai?"
    names = [
        F.when(titled, F.when(mod(F.col("docno"), 2), F.lit(t)).otherwise(F.lit(d)))
        for t, d in zip(fixed.TITLES_TABULAR, read)
    ]
    date = F.when(mod(e, 37), F.lit("38/07/2020")).otherwise(
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (e % 90).cast("int")), "dd/MM/yyyy")
    )

    def punch(k: int) -> Column:
        hour = f"{7 + 2 * k:02d}"
        clock = F.when(mod(e + k, 31), F.concat(F.lit("O" + hour[1:] + ":"), F.col("mm"))).otherwise(_hm(7 + 2 * k))
        tail = F.when(mod(e + k, 29), F.lit("€")).when(mod(e + k, 3), F.lit("d")).otherwise(F.lit(""))
        return F.when(e % 9 > k, F.concat(F.lit("+" if k == 7 else ""), clock, tail))

    body = [
        _row(top, _w(date, 15), *[_w(punch(k), xs[k + 1]) for k in range(8)]),
        _row(
            top,
            _w(F.when(mod(e, 9), F.lit("NATAL")), 95),
            _w(F.when(mod(e, 4), F.lit("07:00")), 405),
        ),
    ]
    head = [_run(10, "CARTAO", "DE", "PONTO"), _titles(50, names, xs)]
    return _assemble(rows, head, body, F.col("r"), "docno")


def render_continuation(spark: SparkSession, sf_dir: str):
    rows = _event_rows(spark, sf_dir, "C", 62, 31)
    e, top = F.col("e"), 70 + 28 * F.col("r")
    xs = [10, 60, 120, 190, 260, 330, 420]
    day = (F.col("r") + 1).cast("string")
    month = F.when(mod(F.col("docno"), 13), F.lit("17")).otherwise(
        ((F.col("docno") + F.col("page")) % 12 + 1).cast("string")
    )
    more = e % 3
    body = [
        _row(
            top, _w(day, 10), _w("SEG", 60), _w("08:00", 120),
            _w(F.when(~mod(e, 5), _hm(8)), 190), _w(_hm(12), 260), _w("HE", 330), _w("00:13", 420),
        ),
        _row(
            top + 14,
            _w(F.when(more == 2, day), 10),
            _w(F.when(more > 0, _hm(13)), 190),
            _w(F.when(more > 0, _hm(17)), 260),
        ),
    ]
    head = [
        _run(10, "SIPON", "Mes/Ano", ":", month, "/", "2012", step=60.0),
        _titles(50, fixed.TITLES_CONTINUATION, xs),
    ]
    return _assemble(rows, head, body, F.col("r"), "docno")


def render_interval(spark: SparkSession, sf_dir: str):
    rows = _event_rows(spark, sf_dir, "I", 40, 20)
    e, top = F.col("e"), 70 + 14 * F.col("r")
    xs = [10, 80, 150, 220, 320, 420, 520]
    day = pad2(F.col("r") + 1)
    glued, holiday = mod(e, 4), mod(e, 10)
    works = ~holiday
    joined = mod(e, 3)
    body = [
        _row(
            top,
            _w(F.when(glued, F.concat(day, F.lit("QUA"))).otherwise(day), 10),
            _w(F.when(~glued, F.lit("QUA")), 30),
            _w(F.when(holiday, F.lit("Feriado")).when(mod(e, 2), F.concat(_hm(9), F.lit("-"))).otherwise(_hm(9)), 80),
            _w(F.when(works & ~mod(e, 2), F.lit("-")), 118),
            _w(F.when(works, _hm(18)), 150),
        ),
        _row(
            top,
            _w(F.when(works & ~joined, F.lit("12:00")), 216),
            _w(F.when(works & joined, F.lit("12:00-13:00")), 220),
            _w(F.when(works & ~joined, F.lit("13:00")), 243),
            _w(F.when(works & mod(e, 7) & ~joined, F.lit("13:30")), 268),
            _w(F.when(works & mod(e, 7) & joined, F.lit("13:30")), 278),
            _w(F.when(works & mod(e, 6), F.lit("15:00")), 320),
        ),
    ]
    month = pad2(F.col("docno") % 12 + 1)
    head = [
        _run(10, "Relatório", "Mensal", "Mês/Ano:", F.concat(month, F.lit("/2010"))),
        _titles(50, fixed.TITLES_INTERVAL, xs),
    ]
    return _assemble(rows, head, body, F.col("r"), "docno")


def _order_rows(spark, sf_dir, letter: str, per_doc: int, per_page: int) -> DataFrame:
    k = F.col("k")
    return _dealt(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    ), "k").select(
        "k",
        "cents",
        F.floor(k / per_doc).alias("docno"),
        F.concat(F.lit(letter), F.floor(k / per_doc).cast("string")).alias("doc_id"),
        (F.floor((k % per_doc) / per_page) + 1).cast("int").alias("page"),
        (k % per_page).cast("int").alias("r"),
    )


def _amount(j: int) -> Column:
    """Amounts of an order, each a little larger than the last; one parsed expression."""
    cents = f"(cents + {137 * j})"
    return F.expr(
        f"concat(replace(format_number({cents} div 100, 0), ',', '.'), ',',"
        f" lpad(cast({cents} % 100 AS STRING), 2, '0'))"
    )


def render_monthly(spark: SparkSession, sf_dir: str):
    rows = _order_rows(spark, sf_dir, "M", 12, 1)
    k = F.col("k")
    table_ = ~mod(k, 17)
    xs = [10, 60, 200, 300, 400]
    show = lambda text, cond=None: F.when(table_ if cond is None else table_ & cond, text if isinstance(text, Column) else F.lit(text))
    body = [
        _run(10, "Período", ":", F.concat(pad2(k % 12 + 1), F.lit("/"), (F.floor(k / 12) % 20 + 2000).cast("string"))),
        _run(24, show("Salário"), show("Base"), show(":"), show(_amount(99))),
        _titles(50, [show(t) for t in fixed.TITLES_MONTHLY], xs),
    ]
    for j in range(6):
        has = k % 6 >= j
        value = damage(_amount(j), mod(k + j, 41), "O")
        body.append(
            _row(
                64 + 14 * j,
                _w(show(f"{j + 1:04d}", has), 10),
                _w(show("Verba", has), 60),
                _w(show(f"N{j}", has), 90),
                _w(show("30,00", has) if j % 3 else F.lit(None).cast("string"), 205),
                _w(show(value, has), 400 if j % 2 else 300),
            )
        )
    body += [
        _row(160, _w(show("Total"), 10), _w(show(_amount(10)), 300), _w(show(_amount(11), ~mod(k, 4)), 400)),
        _row(174, _w(show("Líqüido"), 10), _w(show(_amount(12)), 350)),
        _run(
            188, show("Base"), show("INSS"), show(":"), show(_amount(13)), show("FGTS:"),
            show(_amount(14), ~mod(k, 3)),
        ),
        _run(202, show("Assinado"), show("por:"), show("Fulano")),
    ]
    return _printed(rows, body, F.lit(0)), _page_table(rows)


_RECEIPT_MONTHS = [m.upper() for m in fixed.MONTH_NAMES[:9]] + ["PUTUBRO", "NOVEMBRO", "PEEMBRO"]


def render_receipt(spark: SparkSession, sf_dir: str):
    rows = _order_rows(spark, sf_dir, "R", 6, 1)
    k = F.col("k")
    name = F.get(F.array(*[F.lit(m) for m in _RECEIPT_MONTHS]), (k % 12).cast("int"))
    year = (k % 10 + 2015).cast("string")
    body = []
    for t in (0.0, 500.0):
        body += [
            _run(t + 10, "Recibo", "de", "Pagamento"),
            _run(t + 24, F.when(mod(k, 2), F.concat(name, F.lit("/"), year)).otherwise(name), "MENSAL"),
            _run(t + 38, F.when(~mod(k, 2), year), "x"),
            _titles(t + 60, fixed.TITLES_RECEIPT, [10, 140, 200, 290, 420, 480]),
        ]
        for j in range(4):
            has = k % 4 >= j
            show = lambda text, cond=has: F.when(cond, text if isinstance(text, Column) else F.lit(text))
            right = has & F.lit(j % 3 != 2)
            body.append(
                _row(
                    t + 74 + 14 * j,
                    _w(show(f"PROV{j}"), 10),
                    _w(show("30") if j % 2 == 0 else F.lit(None).cast("string"), 140),
                    _w(show(damage(_amount(j), mod(k + j, 23), "O")), 195),
                    _w(show(f"DESC{j}", right), 290),
                    _w(show("AMIL", right & mod(k + j, 5)), 400),
                    _w(show(_amount(j + 20), right), 475),
                )
            )
        lost = F.when(mod(k, 2), F.lit("TOTAL")).otherwise(F.lit("OTAL"))
        body += [
            _run(t + 140, lost, "DE", "PROVENTOS", _amount(30), "TOTAL", "DE", "DESCONTOS", _amount(31), step=70.0),
            _run(t + 154, "LÍQUIDO", "A", "RECEBER", _amount(32)),
            _titles(t + 168, ["Base", "INSS", "Base", "FGTS", "FGTS", "Mes"], [10, 35, 150, 175, 300, 325]),
            _titles(t + 182, [_amount(33), _amount(34), _amount(35)], [10, 150, 300]),
        ]
    return _printed(rows, body, F.lit(0)), _page_table(rows)


def render_blocks(spark: SparkSession, sf_dir: str):
    rows = _order_rows(spark, sf_dir, "B", 8, 2)
    k, top = F.col("k"), 20 + 200 * F.col("r")
    month = F.when(mod(k, 19), F.lit("13/2018")).otherwise(
        F.concat(pad2(k % 12 + 1), F.lit("/"), (k % 10 + 2010).cast("string"))
    )
    body = [
        _run(top, "Mês/Ano:", month, "Folha:", "MES"),
        _titles(top + 20, fixed.TITLES_BLOCKS, [10, 60, 250, 400]),
    ]
    for j in range(4):
        has = k % 4 >= j
        show = lambda text, cond=has: F.when(cond, text if isinstance(text, Column) else F.lit(text))
        name = F.when(mod(k, 9), F.lit("AD/COMI")).otherwise(F.lit("VENC")) if j == 0 else F.lit("VENC")
        middle = {0: None, 1: _amount(40 + j), 2: F.lit("JULHO/18")}[j % 3]
        value = F.concat(F.lit("-"), _amount(j)) if j % 3 == 1 else _amount(j)
        body.append(
            _row(
                top + 34 + 14 * j,
                _w(show(f"{10 + j:03d}"), 10),
                _w(show(name), 60),
                _w(show(f"P{j}"), 100),
                _w(show(middle) if middle is not None else F.lit(None).cast("string"), 250),
                _w(show(value), 400),
            )
        )
    body.append(_run(top + 110, "Total", "Ref.:", _amount(50), "Retidos:", F.when(~mod(k, 3), _amount(51))))
    return _assemble(rows, [_run(5, "Declaração", "Remuneração")], body, F.col("r"))


def render_ledger(spark: SparkSession, sf_dir: str):
    rows = _order_rows(spark, sf_dir, "F", 12, 6)
    k, top = F.col("k"), 30 + 100 * F.col("r")
    name = F.get(F.array(*[F.lit(m) for m in fixed.MONTH_ABBREVIATIONS]), (k % 12).cast("int"))
    month = F.concat(
        F.when(mod(k, 31), F.lit("xyz")).otherwise(name), F.lit("-"), (k % 15 + 10).cast("string")
    )
    second = ~mod(k, 4)
    show = lambda text: F.when(second, text if isinstance(text, Column) else F.lit(text))
    body = [
        _run(top, "Folha", "Normal"),
        _run(top + 14, "Mês:", month),
        _row(
            top + 28, _w("REMUNMES", 10), _w(_amount(1), 120),
            _w((k % 5 + 290).cast("string"), 200), _w("VA", 230), _w("Func", 245), _w("0", 300), _w(_amount(2), 320),
            _w("BASEINSS", 400), _w(_amount(3), 460),
        ),
        _row(
            top + 42, _w(show("91Hr"), 10), _w(show("Adic"), 40), _w(show("146,67"), 90), _w(show(_amount(4)), 140),
            _w(show("511"), 200), _w(show("INSS"), 230), _w(show(_amount(5)), 320),
            _w(show("FGTS"), 400), _w(show(_amount(6)), 460),
        ),
        _row(
            top + 56, _w("TOT.REND", 10), _w(_amount(7), 120), _w("TOTALDESC", 230), _w(_amount(8), 320),
            _w("LIQUIDO", 400), _w(_amount(9), 460),
        ),
    ]
    head = [_run(5, F.when(F.col("page") == 1, F.lit("FICHA")), F.when(F.col("page") == 1, F.lit("FINANCEIRA")))]
    return _assemble(rows, head, body, F.col("r"))


RENDERERS = {
    "T": render_tabular,
    "C": render_continuation,
    "I": render_interval,
    "M": render_monthly,
    "R": render_receipt,
    "B": render_blocks,
    "F": render_ledger,
}


def rendered(spark: SparkSession, sf_dir: str, letters: str = "TCIMRBF"):
    """Words and pages of several layouts together."""
    words = pages = None
    for letter in letters:
        w, p = RENDERERS[letter](spark, sf_dir)
        words = w if words is None else words.unionByName(w)
        pages = p if pages is None else pages.unionByName(p)
    return words, pages


def render_vertical(spark: SparkSession, sf_dir: str):
    """Days set one below another: a line with the date, then a line for each punch, and perhaps a note that voids the day.

    The last day of a page ends on the next one. Every seventh document has half its title, every eleventh dates no day,
    every thirteenth also carries the titles of the tabular layout.
    """
    rows = _event_rows(spark, sf_dir, "V", 40, 20)
    e = F.col("e")
    late = (F.col("page") == 1) & (F.col("r") == 19)
    top = 70 + 84 * F.col("r")
    date = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (e % 90).cast("int")), "dd/MM/yyyy")
    dated = F.when(mod(F.col("docno"), 11), F.lit("Data")).otherwise(F.lit("Dia"))
    more = mod(e, 3)

    def tail(at: Column) -> list[Column]:
        return [
            _run(at, "saída", _hm(12)),
            _run(at + 14, F.when(more, F.lit("entrada")), F.when(more, F.concat(F.lit("O1:"), F.col("mm")))),
            _run(at + 28, F.when(more, F.lit("saída")), F.when(more, _hm(17))),
            _run(at + 42, F.when(mod(e, 5), F.lit("obs:")), F.when(mod(e, 5), F.lit("anulado"))),
        ]

    head = [
        _run(0, "Espelho", F.when(~mod(F.col("docno"), 7), F.lit("Vertical"))),
        _titles(10, [F.when(mod(F.col("docno"), 13), F.lit(t)) for t in fixed.TITLES_TABULAR],
                [15, 95, 131, 184, 220, 256, 292, 328, 364, 400, 440, 480, 520, 580]),
    ]
    words = _printed(_pages_of(rows, "docno"), head, F.lit(0)).unionByName(
        _printed(rows, [_run(top, dated, date), _run(top + 14, "entrada", _hm(8))], F.col("r") + 1)
    ).unionByName(_printed(rows.where(~late), tail(top + 28), F.col("r") + 41))
    ends = rows.where(late).withColumn("page", F.lit(2))
    words = words.unionByName(_printed(ends, tail(F.lit(21.0)), F.lit(90)))
    return words, _page_table(words)


def render_month_names(spark: SparkSession, sf_dir: str):
    """A month name and year on each page, the name damaged in one of four ways."""
    rows = _order_rows(spark, sf_dir, "Z", 6, 1)
    k = F.col("k")
    name = F.upper(F.get(F.array(*[F.lit(m) for m in fixed.MONTH_NAMES]), (k % 12).cast("int")))
    kind = (k + F.floor(k / 12)) % 5
    read = (
        F.when(kind == 1, F.concat(F.lit("PE"), F.substr(name, F.lit(4))))
        .when(kind == 2, F.substr(name, F.lit(2)))
        .when(kind == 3, F.replace(name, F.lit("O"), F.lit("0")))
        .when(kind == 4, F.concat(F.lit("JU"), F.substr(name, F.lit(4)), F.lit("O")))
        .otherwise(name)
    )
    year = (k % 3 + 2015).cast("string")
    return _printed(rows, [_run(10, F.concat(read, F.lit("/"), year), "MENSAL")], F.lit(0)), _page_table(rows)


def with_damaged_amounts(words: DataFrame) -> DataFrame:
    """Every printed amount that ends in 7 read as if it ended in a letter."""
    return words.withColumn("text", damage(F.col("text"), is_money(F.col("text")) & F.endswith("text", F.lit("7")), "l"))


def rendered_documents(pages: DataFrame) -> DataFrame:
    """Declared type of each rendered document; every fifth is declared wrongly."""
    ts = F.substr(F.col("doc_id"), F.lit(1), F.lit(1)).isin("T", "C", "I")
    wrong = mod(F.substr(F.col("doc_id"), F.lit(2)).cast("bigint"), 5)
    return pages.select("doc_id").distinct().select(
        "doc_id",
        F.when(ts != wrong, F.lit(fixed.TIMECARD)).otherwise(F.lit(fixed.PAYSLIP)).alias("doc_type"),
    )

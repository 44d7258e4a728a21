"""One query per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgrid import fixed, session
from inkgrid.functions import text as txt
from inkgrid.functions import tokens as tok
from inkgrid.functions.similarity import title_similarity
from inkgrid.operators import choice, corrections, findings, geometry, grid, headers, totals
from inkgrid.plans import coded, layouts, lifecycle, payslip, timecard, transcribe
from inkgrid.schemas import RECORDED_WORDS
from inkgrid.sources import intake, sinks, store, values
from inkgrid.sources import words as word_sources
from inkgrid.streaming import intake as streams
from suite import adapters as ad

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs -----------------------------------------------------------


def _matched(spark, sf_dir, letters, only=layouts.LAYOUTS):
    words, pages = ad.rendered(spark, sf_dir, letters)
    return transcribe.matched_lines(words, pages, only), pages


def _builder_lines(spark, sf_dir, letter, layout):
    words, pages = ad.rendered(spark, sf_dir, letter)
    return transcribe.builder_lines(words, pages, (layout,)), pages


def _days(spark, sf_dir, letter):
    layout = {"C": layouts.CONTINUATION, "T": layouts.TABULAR, "I": layouts.INTERVAL}[letter]
    matched, pages = _builder_lines(spark, sf_dir, letter, layout)
    return timecard.DAY_BUILDERS[layout.layout_id](matched), pages


def _entries(spark, sf_dir, letter):
    layout = {"M": layouts.MONTHLY, "R": layouts.RECEIPT, "B": layouts.BLOCKS, "F": layouts.LEDGER}[letter]
    matched, pages = _builder_lines(spark, sf_dir, letter, layout)
    return transcribe.ENTRY_BUILDERS[layout.layout_id](matched, pages)


def _joined(items: Column, *names: str) -> Column:
    """An array of structs as one text, for comparison."""
    return F.array_join(F.transform(items, lambda p: F.concat_ws("~", *[p[n] for n in names])), "|")


def _day_text(days: DataFrame) -> DataFrame:
    return days.select(
        "doc_id", "page", "day_pos", "date_raw",
        _joined(F.col("punches"), "kind", "time_raw", "time_hhmm").alias("punches"),
    )


def _entry_text(entries: DataFrame) -> DataFrame:
    return entries.select(
        "doc_id", "page", "entry_no", "year", "month",
        _joined(F.col("fields"), "code", "label", "reference", "value").alias("fields"),
        _joined(F.col("bases"), "label", "value").alias("bases"),
    )


def _a1_lines(spark, sf_dir):
    return geometry.build_lines(ad.a1_words(spark, sf_dir))


def _a2_summary(spark, sf_dir):
    return findings.summarise_days(ad.a2_days(spark, sf_dir), ad.a2_punches(spark, sf_dir))


# --- sources and sinks ---------------------------------------------------------


@query
def src_intake_files(spark, sf_dir):
    files = ad.a5_files(spark, sf_dir)
    return files.select("doc_id", "source_path", "length", intake.size_verdict(F.col("length"), 4000).alias("verdict"))


@query
def src_words_json(spark, sf_dir):
    recorded = word_sources.record_pages(
        ad.a1_words(spark, sf_dir).withColumn("confidence", F.lit(None).cast("double")),
        ad.a1_pages(spark, sf_dir),
    )
    as_text = recorded.withColumn("words", F.to_json("words"))
    back = word_sources.explode_recorded(as_text.withColumn("words", F.from_json("words", RECORDED_WORDS)))
    return back.groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.sum("x1").alias("sum_x1"), F.sum("bottom").alias("sum_bottom"),
        F.count("confidence").alias("n_conf"),
    )


def _ocr_rows(spark, sf_dir):
    i = F.col("word_seq")
    return ad.a1_words(spark, sf_dir).select(
        "doc_id", "page", "word_seq",
        F.when(i % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("text"))).alias("text"),
        F.when(i % 11 == 0, F.lit("-1")).when(i % 13 == 0, F.lit("x")).otherwise((i % 101).cast("string")).alias("conf"),
        (i % 12 * 166).alias("left"), (F.floor(i / 12) % 50 * 58).cast("int").alias("top"),
        (F.char_length("text") * 20).alias("width"), F.lit(42).alias("height"),
        F.when(F.col("doc_id").cast("bigint") % 2 == 0, 300).otherwise(200).alias("dpi"),
    )


@query
def src_ocr_tsv_words(spark, sf_dir):
    return word_sources.ocr_words(_ocr_rows(spark, sf_dir)).groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("conf"), F.min("confidence").alias("lowest"),
        F.round(F.sum("x1"), 3).alias("x1"), F.round(F.sum("bottom"), 3).alias("bottom"),
        F.sum(F.char_length("text")).alias("chars"),
    )


@query
def src_native_words(spark, sf_dir):
    rows = ad.a1_words(spark, sf_dir).withColumn(
        "text", F.when(F.col("word_seq") % 9 == 0, F.lit(" ")).otherwise(F.col("text"))
    )
    return word_sources.native_words(rows).groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.count("confidence").alias("n_conf"), F.sum(F.char_length("text")).alias("chars")
    )


def _tab_values(spark, sf_dir):
    days, pages = _days(spark, sf_dir, "T")
    return timecard.nest_timecards(days, pages)


@query
def src_value_json(spark, sf_dir):
    stored = _tab_values(spark, sf_dir).select("doc_id", values.value_json(F.col("value")).alias("value"))
    back = stored.withColumn("value", values.parse_timecard(F.col("value")))
    days = values.flatten_timecards(back)
    return days.select(
        "doc_id", "page", "day_pos", "date_raw",
        _joined(F.col("punches"), "kind", "time_raw", "time_hhmm").alias("punches"),
    )


@query
def sink_json(spark, sf_dir):
    """The texts themselves, as written and read again."""
    path = session.fresh_path(spark)
    sinks.write_json(payslip.nest_payslips(_entries(spark, sf_dir, "B")), path, folders=4)
    return spark.read.parquet(path).select("doc_id", "json")


def _tab_grid(spark, sf_dir):
    days, _ = _days(spark, sf_dir, "T")
    flat = findings.summarise_nested_days(days)
    punches = timecard.flat_punches(days).withColumn("page_pos", F.col("page") - 1)
    return grid.timecard_grid(flat, punches), flat


@query
def sink_csv(spark, sf_dir):
    days, _ = _days(spark, sf_dir, "T")
    lines = sinks.sheet_csv_lines(grid.timecard_sheet(days))
    return lines.select(
        "doc_id", F.coalesce("page_pos", F.lit(-1)).alias("page_pos"),
        F.coalesce("day_pos", F.lit(-1)).alias("day_pos"), "line",
    )


@query
def sink_store(spark, sf_dir):
    path = session.fresh_path(spark)
    sinks.write_store(ad.a4_transcriptions(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("created_on").cast("string").alias("created_on"), "doc_type", "status").agg(
        F.count("*").alias("n"), F.count("value").alias("n_values"), F.count("error").alias("n_errors")
    )


@query
def opaque_id(spark, sf_dir):
    return ad.a5_files(spark, sf_dir).select("source_path", intake.opaque_id(F.col("source_path"), "salt").alias("id"))


# --- projections and filters -----------------------------------------------------


@query
def intake_signature(spark, sf_dir):
    return ad.a5_files(spark, sf_dir).select("doc_id", intake.has_signature(F.col("head")).alias("is_pdf"))


@query
def intake_page_limit(spark, sf_dir):
    counts = intake.page_counts(ad.a1_pages(spark, sf_dir))
    return counts.select("doc_id", "n_pages", intake.page_verdict(F.col("n_pages"), 6).alias("verdict"))


@query
def intake_verdict(spark, sf_dir):
    return intake.intake_verdict(ad.a5_files(spark, sf_dir), max_bytes=4000).select("doc_id", "verdict", "error")


@query
def page_is_empty(spark, sf_dir):
    counts = word_sources.words_per_page(ad.a1_words(spark, sf_dir), ad.a1_pages(spark, sf_dir))
    return counts.select("doc_id", "page", (F.col("n_words") == 0).alias("is_empty"))


@query
def below_header(spark, sf_dir):
    matched, _ = _matched(spark, sf_dir, "M", (layouts.MONTHLY,))
    return timecard.below_header(headers.with_header(matched, layouts.MONTHLY)).groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.min("top").alias("first_top"), F.min_by("text", "line_no").alias("first_line")
    )


@query
def words_between(spark, sf_dir):
    inside = geometry.words_between(F.col("words"), F.lit(100.0), F.lit(300.0))
    return _a1_lines(spark, sf_dir).select(
        "doc_id", "page", "line_no", F.size(inside).alias("n"), F.array_join(inside["text"], " ").alias("text")
    )


@query
def envelope_projection(spark, sf_dir):
    return values.envelope(ad.a4_transcriptions(spark, sf_dir))


@query
def exportable(spark, sf_dir):
    return values.exportable(ad.a4_transcriptions(spark, sf_dir)).select("id", "doc_type", "value")


def _updates(spark, sf_dir):
    """An update per order: several for some ids, some for ids nobody knows."""
    return ad.table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 12000).cast("string").alias("id"),
        F.concat(F.lit('{"v": '), F.col("o_orderkey").cast("string"), F.lit("}")).alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


@query
def editable(spark, sf_dir):
    return values.editable(ad.a4_transcriptions(spark, sf_dir), _updates(spark, sf_dir)).select("id", "value", "refused")


@query
def has_uncertainty(spark, sf_dir):
    days, _ = _days(spark, sf_dir, "T")
    return findings.summarise_nested_days(days).select("doc_id", "page_pos", "day_pos", "marked")


@query
def schema_contract(spark, sf_dir):
    """Stored values with faults planted by hand; every fault must be named."""
    e = F.col("day_pos") + 30 * (F.col("page") - 1)
    days, pages = _days(spark, sf_dir, "T")
    faulty = days.withColumn("date_raw", F.when(e % 17 != 0, F.col("date_raw"))).withColumn(
        "punches",
        F.when(
            e % 13 == 0,
            F.transform("punches", lambda p: F.struct(F.lit("XX").alias("kind"), p["time_raw"].alias("time_raw"), p["time_hhmm"].alias("time_hhmm"))),
        ).otherwise(F.col("punches")),
    )
    nested = _with_damaged_values(timecard.nest_timecards(faulty, pages), "days", values.parse_timecard)
    bad = values.timecard_violations(nested)
    return bad.groupBy("doc_id", "page", "reason").agg(F.count("*").alias("n"))


def _with_damaged_values(nested, items, parse):
    """Values as stored text and back; of some documents the text is cut off, of others the first list is NULL."""
    docno = F.substr("doc_id", F.lit(2)).cast("bigint")
    text = F.to_json("value", {"ignoreNullFields": "false"})
    gone = F.regexp_replace(text, f'"{items}":\\[', f'"{items}":null,"was":[')
    stored = F.when(docno % 19 == 3, F.lit("{")).when(docno % 19 == 5, gone).otherwise(text)
    return nested.select("doc_id", parse(stored).alias("value"))


@query
def payslip_contract(spark, sf_dir):
    """Payslips with a fault of each kind planted by hand; every fault must be named."""
    o = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    flat = ad.a3_entries(spark, sf_dir)
    fields = F.when(o % 9 != 4, F.array(F.struct(
        F.lit("0001").alias("code"), F.when(o % 9 != 5, F.lit("Total")).alias("label"), F.lit("").alias("reference"),
        F.coalesce("total", F.lit("0,00")).alias("value"),
    )))
    bases = F.array(F.struct(F.lit("Total").alias("label"), F.when(o % 9 != 6, F.lit("1,00")).alias("value")))
    page = F.struct(
        F.when(o % 9 != 1, F.col("page")).alias("page"), F.when(o % 9 != 2, F.col("year")).otherwise(none).alias("year"),
        F.when(o % 9 == 3, F.lit("13")).otherwise(F.col("month")).alias("month"), fields.alias("fields"), bases.alias("bases"),
    )
    nested = flat.groupBy("doc_id").agg(F.struct(
        F.transform(F.array_sort(F.collect_list(F.struct("entry_pos", page.alias("p")))), lambda x: x["p"]).alias("pages")
    ).alias("value"))
    cut = F.when(F.col("doc_id").cast("bigint") % 19 == 3, F.lit("not json")).otherwise(F.to_json("value", {"ignoreNullFields": "false"}))
    bad = values.payslip_violations(nested.select("doc_id", values.parse_payslip(cut).alias("value")))
    return bad.groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


# --- joins -------------------------------------------------------------------------


def _bands(pages):
    """Six columns of 90 points on every page, the last one to its edge."""
    bands = F.array(
        *[
            F.struct(F.lit(k).alias("ord"), F.lit(90.0 * k).alias("x0"), (F.lit(90.0 * (k + 1)) if k < 5 else F.col("width")).alias("x1"))
            for k in range(6)
        ]
    )
    return pages.select("doc_id", "page", F.inline(bands))


@query
def join_column_range(spark, sf_dir):
    words, pages = ad.a1_words(spark, sf_dir), ad.a1_pages(spark, sf_dir)
    return geometry.join_column_ranges(words, _bands(pages.select("doc_id", "page", "width"))).groupBy("doc_id", "page", "ord").agg(
        F.count("*").alias("n"), F.sum("word_seq").alias("seqs")
    )


@query
def join_header_titles(spark, sf_dir):
    matched, _ = _matched(spark, sf_dir, "TI", (layouts.TABULAR, layouts.INTERVAL))
    hits = matched.select("doc_id", "page", "line_no", F.inline("matches"))
    return hits.select("doc_id", "page", "line_no", "layout", F.round("score", 6).alias("score"), F.size("at").alias("n_titles"))


@query
def join_layout_candidates(spark, sf_dir):
    _, pages = ad.rendered(spark, sf_dir, "TM")
    table = spark.createDataFrame([(x.layout_id, x.name, x.doc_type) for x in layouts.LAYOUTS], "layout_id int, layout string, doc_type string")
    # seven configuration rows: a fixed size, whatever the corpus
    return ad.rendered_documents(pages).join(F.broadcast(table), "doc_type").select("doc_id", "doc_type", "layout")


@query
def join_competence(spark, sf_dir):
    days, _ = _days(spark, sf_dir, "C")
    return days.select("doc_id", "page", "day_pos", "date_raw")


@query
def join_nearest_label(spark, sf_dir):
    entries = _entries(spark, sf_dir, "R")
    return payslip.flat_bases(entries).select("doc_id", "page", "base_pos", "label", "value")


@query
def join_prev_line(spark, sf_dir):
    before = F.lag("text").over(geometry.in_reading_order())
    return _a1_lines(spark, sf_dir).select("doc_id", "page", "line_no", "text", F.coalesce(before, F.lit("")).alias("line_above"))


def _page_sources(spark, sf_dir):
    words, pages = ad.a1_words(spark, sf_dir), ad.a1_pages(spark, sf_dir)
    chosen = word_sources.choose_source(words, pages, 300)
    delivered = pages.where((F.col("doc_id").cast("bigint") + F.col("page")) % 3 != 0)
    return words, chosen, delivered


@query
def join_page_replace(spark, sf_dir):
    words, chosen, delivered = _page_sources(spark, sf_dir)
    ocr = words.withColumn("text", F.upper("text")).withColumn("top", F.col("top") + 1)
    return word_sources.replace_pages(words, ocr, delivered, chosen).groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.sum("top").alias("tops")
    )


def _tab_review(spark, sf_dir):
    cells, flat = _tab_grid(spark, sf_dir)
    return grid.review_rows(cells, findings.timecard_findings(flat), ["page_pos", "day_pos"])


@query
def join_findings_rows(spark, sf_dir):
    review = grid.assert_in_step(_tab_review(spark, sf_dir))
    return review.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("severity").alias("flagged"), F.sum(F.size("cells")).alias("cells"))


def _corrections(spark, sf_dir):
    """Corrections of punches and dates of A2, some repeated, some of paths that do not exist."""
    e = F.col("event_id")
    log = ad.a2_log(spark, sf_dir)
    root = F.concat(F.lit("pages."), F.col("page_pos"), F.lit(".days."), F.dayofmonth("day") - 1)
    path = (
        F.when(e % 30 == 0, F.concat(root, F.lit(".date_raw")))
        .when(e % 70 == 0, F.concat(root, F.lit(".nothing")))
        .otherwise(F.concat(root, F.lit(".punches."), e % 4, F.lit(".time_hhmm")))
    )
    value = F.when(e % 30 == 0, F.date_format("day", "dd/MM/yyyy")).otherwise(F.date_format("ts", "HH:mm"))
    return log.select("doc_id", path.alias("path"), value.alias("new_value"), F.col("ts").cast("timestamp").alias("ts"))


@query
def join_corrections(spark, sf_dir):
    days, punches = ad.a2_days(spark, sf_dir), ad.a2_punches(spark, sf_dir)
    _, fixed_punches = corrections.correct_timecards(days, punches, _corrections(spark, sf_dir))
    return fixed_punches.select("doc_id", "page_pos", "day_pos", "punch_pos", "time_raw", "time_hhmm")


@query
def apply_corrections(spark, sf_dir):
    """Findings recomputed from corrected days and punches."""
    days, punches = corrections.correct_timecards(
        ad.a2_days(spark, sf_dir), ad.a2_punches(spark, sf_dir), _corrections(spark, sf_dir)
    )
    found = findings.timecard_findings(findings.summarise_days(days, punches))
    return found.select("doc_id", "page_pos", "day_pos", F.array_join("codes", ",").alias("codes"), "severity")


@query
def apply_path(spark, sf_dir):
    days, punches = ad.a2_days(spark, sf_dir), ad.a2_punches(spark, sf_dir)
    fixed_days, _ = corrections.correct_timecards(days, punches, _corrections(spark, sf_dir))
    return fixed_days.select("doc_id", "page_pos", "day_pos", "date_raw")


@query
def reject_corrections(spark, sf_dir):
    paths = corrections.timecard_paths(ad.a2_days(spark, sf_dir), ad.a2_punches(spark, sf_dir))
    return corrections.rejected_corrections(_corrections(spark, sf_dir), paths).select("doc_id", "path", "new_value")


def _corrected_payslips(spark, sf_dir):
    entries = ad.a3_entries(spark, sf_dir)
    return corrections.correct_payslips(
        entries, ad.a3_fields(spark, sf_dir, entries), ad.a3_bases(spark, sf_dir), ad.a3_corrections(spark, sf_dir)
    )


@query
def correct_payslips(spark, sf_dir):
    entries, fields, bases = _corrected_payslips(spark, sf_dir)
    own = entries.select("doc_id", "entry_pos", F.lit("entry").alias("section"), F.lit(0).alias("pos"), F.concat_ws("~", "month", "year").alias("texts"))
    of_fields = fields.select("doc_id", "entry_pos", F.lit("field"), "field_pos", F.concat_ws("~", "code", "label", "reference", "value"))
    of_bases = bases.select("doc_id", "entry_pos", F.lit("base"), "base_pos", F.concat_ws("~", "label", "value"))
    return own.union(of_fields).union(of_bases)


@query
def apply_payslip_corrections(spark, sf_dir):
    """Findings recomputed from corrected entries, fields and bases."""
    found = findings.payslip_findings(findings.summarise_entries(*_corrected_payslips(spark, sf_dir)))
    return found.select("doc_id", "entry_pos", F.array_join("codes", ",").alias("codes"), "severity")


@query
def reject_payslip_corrections(spark, sf_dir):
    entries = ad.a3_entries(spark, sf_dir)
    paths = corrections.payslip_paths(entries, ad.a3_fields(spark, sf_dir, entries), ad.a3_bases(spark, sf_dir))
    return corrections.rejected_corrections(ad.a3_corrections(spark, sf_dir), paths).select("doc_id", "path", "new_value")


@query
def replace_value(spark, sf_dir):
    done = corrections.replace_values(ad.a4_transcriptions(spark, sf_dir), _updates(spark, sf_dir))
    return done.select("id", "status", "value", (F.col("updated_at") != F.col("created_at")).alias("moved"))


@query
def lookup_by_id(spark, sf_dir):
    return values.lookup(ad.a4_transcriptions(spark, sf_dir), "123").select("id", "doc_type", "status", "error")


# --- geometry ------------------------------------------------------------------------


@query
def cluster_lines(spark, sf_dir):
    placed = geometry.assign_lines(ad.a1_words(spark, sf_dir))
    return placed.groupBy("doc_id", "page", "line_no").agg(
        F.count("*").alias("n"), F.min("word_seq").alias("first_word"), F.max("word_seq").alias("last_word"),
        F.max("line_pos").alias("last_pos"),
    )


@query
def cluster_slanted_lines(spark, sf_dir):
    """Lines that touch: each word of a line stands 0.9 lower than the one before, so the reference moves."""
    words = ad.a1_words(spark, sf_dir)
    lower = 0.9 * (F.col("word_seq") % 12)
    slanted = words.withColumns({"top": F.col("top") + lower, "bottom": F.col("bottom") + lower})
    return geometry.assign_lines(slanted).groupBy("doc_id", "page", "line_no").agg(
        F.count("*").alias("n"), F.sum("word_seq").alias("seqs"), F.max("line_pos").alias("last_pos"),
        F.max(F.when(F.col("line_pos") == 0, F.col("word_seq"))).alias("leftmost"),
    )


@query
def line_text(spark, sf_dir):
    return _a1_lines(spark, sf_dir).select("doc_id", "page", "line_no", "text")


@query
def page_text(spark, sf_dir):
    return geometry.page_text(_a1_lines(spark, sf_dir)).select("doc_id", "page", F.md5("text").alias("digest"), F.char_length("text").alias("chars"))


@query
def source_choice(spark, sf_dir):
    return word_sources.choose_source(ad.a1_words(spark, sf_dir), ad.a1_pages(spark, sf_dir))


@query
def detect_header(spark, sf_dir):
    only = (layouts.TABULAR, layouts.MONTHLY)
    matched, _ = _matched(spark, sf_dir, "TM", only)
    found = headers.detect_headers(matched, only)
    return found.select("doc_id", "page", "layout_id", "header_top", F.round("score", 6).alias("score"), F.inline("cols")).select(
        "doc_id", "page", "layout_id", "header_top", "score", F.col("ord"), "name", "x0", "x1"
    )


@query
def title_similarity_of_words(spark, sf_dir):
    """Every different word of the corpus against a title."""
    words = ad.document_tokens(spark, sf_dir).select(F.explode("tokens").alias("w")).distinct()
    plain = words.select(txt.normalize_word(F.col("w")).alias("w")).distinct()
    return plain.select("w", title_similarity("w", F.lit("entrada")).alias("ratio"))


@query
def column_by_name(spark, sf_dir):
    matched, _ = _matched(spark, sf_dir, "I", (layouts.INTERVAL,))
    found = headers.detect_headers(matched, (layouts.INTERVAL,))
    col = headers.column_by_name(F.col("cols"), "INTERVALO")
    return found.select("doc_id", "page", col["ord"].alias("ord"), col["x0"].alias("x0"), col["x1"].alias("x1"))


def _all_scores(spark, sf_dir):
    matched, pages = _matched(spark, sf_dir, "TCIMRBF")
    return choice.score_layouts(matched), pages


@query
def score_layouts(spark, sf_dir):
    scores, _ = _all_scores(spark, sf_dir)
    return scores.select("doc_id", "layout", "score")


@query
def select_layout(spark, sf_dir):
    scores, pages = _all_scores(spark, sf_dir)
    return choice.select_layout(ad.rendered_documents(pages), scores).select("doc_id", "doc_type", "layout", "error")


@query
def split_tables(spark, sf_dir):
    fields = payslip.flat_fields(_entries(spark, sf_dir, "R"))
    return fields.select("doc_id", "page", "field_pos", "label", "reference", "value")


@query
def split_three_groups(spark, sf_dir):
    matched, _ = _matched(spark, sf_dir, "F", (layouts.LEDGER,))
    cut = matched.join(payslip.code_cut(matched), "doc_id", "left")
    groups = payslip.split_groups(F.col("words"), F.col("cut"))
    return cut.where(F.exists("words", lambda w: tok.is_money(w["text"]))).select(
        "doc_id", "page", "line_no",
        *[F.array_join(groups[g], " ").alias(g) for g in ("earned", "deducted", "result")],
    )


@query
def code_column_cut(spark, sf_dir):
    """Three-digit tokens of the documents and where the upper median of their places is."""
    words = ad.a1_words(spark, sf_dir).withColumn(
        "text", F.when(F.col("word_seq") % 5 == 0, F.lpad((F.col("word_seq") % 1000).cast("string"), 3, "0")).otherwise(F.col("text"))
    )
    return payslip.code_cut(geometry.build_lines(words))


@query
def cell_grouping(spark, sf_dir):
    cells = geometry.group_cells(F.col("words"))
    return _a1_lines(spark, sf_dir).select("doc_id", "page", "line_no", F.posexplode(cells).alias("cell_no", "c")).select(
        "doc_id", "page", "line_no", "cell_no", "c.label", "c.centre"
    )


@query
def label_value_pairs(spark, sf_dir):
    pairs = geometry.label_value_pairs(F.col("texts"), tok.is_money)
    return ad.a6_lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(pairs).alias("pair_no", "p")).select(
        "doc_id", "line_no", "pair_no", "p.label", "p.value"
    )


# --- layouts -------------------------------------------------------------------------


@query
def ts_continuation(spark, sf_dir):
    return _day_text(_days(spark, sf_dir, "C")[0])


@query
def ts_tabular(spark, sf_dir):
    return _day_text(_days(spark, sf_dir, "T")[0])


@query
def ts_interval(spark, sf_dir):
    return _day_text(_days(spark, sf_dir, "I")[0])


@query
def ps_monthly(spark, sf_dir):
    return _entry_text(_entries(spark, sf_dir, "M"))


@query
def ps_receipt(spark, sf_dir):
    return _entry_text(_entries(spark, sf_dir, "R"))


@query
def ps_blocks(spark, sf_dir):
    return _entry_text(_entries(spark, sf_dir, "B"))


@query
def ps_ledger(spark, sf_dir):
    return _entry_text(_entries(spark, sf_dir, "F"))


def _damaged(spark, sf_dir, letter):
    layout = {"R": layouts.RECEIPT, "B": layouts.BLOCKS, "F": layouts.LEDGER}[letter]
    words, pages = ad.rendered(spark, sf_dir, letter)
    matched = transcribe.builder_lines(ad.with_damaged_amounts(words), pages, (layout,))
    return matched, transcribe.ENTRY_BUILDERS[layout.layout_id](matched, pages, strict=False)


@query
def ps_receipt_damaged(spark, sf_dir):
    return _entry_text(_damaged(spark, sf_dir, "R")[1])


@query
def ps_blocks_damaged(spark, sf_dir):
    return _entry_text(_damaged(spark, sf_dir, "B")[1])


@query
def ps_ledger_damaged(spark, sf_dir):
    return _entry_text(_damaged(spark, sf_dir, "F")[1])


@query
def amount_balance(spark, sf_dir):
    """Amounts of three damaged layouts, read against kept."""
    balance = [payslip.amount_balance(*_damaged(spark, sf_dir, letter)) for letter in "RBF"]
    return reduce(DataFrame.unionByName, balance).groupBy("doc_id", "page").agg(
        F.sum("n_read").alias("n_read"), F.sum("n_kept").alias("n_kept"),
        F.bool_or(F.col("n_kept") > F.col("n_read")).alias("made_up"),
    )


@query
def unmatched_page(spark, sf_dir):
    value = _tab_values(spark, sf_dir)
    return value.select("doc_id", F.explode("value.pages").alias("p")).select("doc_id", "p.page", F.size("p.days").alias("n_days"))


@query
def transcribe_corpus(spark, sf_dir):
    """Seven layouts mixed: choice, then rows read per document."""
    words, pages = ad.rendered(spark, sf_dir)
    out = transcribe.transcribe(words, pages, ad.rendered_documents(pages))
    d = out["days"].groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(F.size("punches")).alias("items"))
    e = out["entries"].groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.sum(F.size("fields") + F.size("bases")).alias("items")
    )
    return out["choice"].join(d.unionByName(e), "doc_id", "left").select(
        "doc_id", "layout", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("items", F.lit(0)).alias("items")
    )


def _vertical_score(lines):
    """Half the title is enough, a dated day must be there."""
    dated = lines["ntext"].str.match(r"dia \d{2}/\d{2}/\d{4}$").any()
    return 0.0 if not dated else 1.0 if lines["ntext"].iloc[0] == "espelho vertical" else 0.8


def _vertical_days(lines):
    """A day runs from its date to the next one, over page ends; a note empties the day it follows."""
    days, count = [], {}
    for page, text, words in zip(lines["page"], lines["ntext"], lines["words"]):
        if text.startswith("dia "):
            days.append({"page": page, "day_pos": count.get(page, 0), "date_raw": words[1]["text"], "punches": []})
            count[page] = count.get(page, 0) + 1
        elif days and text.startswith(("entrada ", "saida ")):
            clock = "".join(c if c.isdigit() or c == ":" else "?" for c in words[1]["text"])
            known = ":".join("??" if "?" in part else part for part in clock.split(":"))
            kind = "IN" if text.startswith("entrada") else "OUT"
            days[-1]["punches"].append({"kind": kind, "time_raw": clock, "time_hhmm": known})
        elif days and text == "obs: anulado":
            days[-1]["punches"] = []
    return days


VERTICAL = coded.CodedLayout(
    8, "ts_vertical", fixed.TIMECARD, _vertical_score, _vertical_days, lambda: F.startswith("ntext", F.lit("espelho"))
)


@query
def coded_layout(spark, sf_dir):
    """An eighth layout, in code, among documents of a configured one."""
    words, pages = ad.render_vertical(spark, sf_dir)
    more_words, more_pages = ad.rendered(spark, sf_dir, "T")
    pages = pages.unionByName(more_pages)
    number = F.substr("doc_id", F.lit(2)).cast("bigint")
    documents = pages.select("doc_id").distinct().select(
        "doc_id", F.when(ad.mod(number, 5), F.lit(fixed.PAYSLIP)).otherwise(F.lit(fixed.TIMECARD)).alias("doc_type")
    )
    out = transcribe.transcribe(words.unionByName(more_words), pages, documents, coded=(VERTICAL,))
    days = _day_text(out["days"])
    return out["choice"].select("doc_id", "layout", "score").join(days, "doc_id", "left").select(
        "doc_id", "layout", "score", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("day_pos", F.lit(-1)).alias("day_pos"),
        "date_raw", "punches",
    )


# --- aggregations ----------------------------------------------------------------------


@query
def agg_words_per_page(spark, sf_dir):
    return word_sources.words_per_page(ad.a1_words(spark, sf_dir), ad.a1_pages(spark, sf_dir))


@query
def agg_median_height(spark, sf_dir):
    return totals.median_height(ad.a1_words(spark, sf_dir))


@query
def agg_mean_similarity(spark, sf_dir):
    matched, _ = _matched(spark, sf_dir, "T", (layouts.TABULAR,))
    return headers.detect_headers(matched, (layouts.TABULAR,)).select("doc_id", "page", F.round("score", 6).alias("score"))


@query
def agg_mean_width(spark, sf_dir):
    return totals.mean_width(geometry.assign_lines(ad.a1_words(spark, sf_dir)))


@query
def agg_line_bounds(spark, sf_dir):
    return _a1_lines(spark, sf_dir).select("doc_id", "page", "line_no", "top", "bottom")


@query
def agg_max_punches(spark, sf_dir):
    return grid.max_punches(_a2_summary(spark, sf_dir))


def _a3(spark, sf_dir):
    entries = ad.a3_entries(spark, sf_dir)
    return entries, ad.a3_fields(spark, sf_dir, entries)


@query
def agg_label_union(spark, sf_dir):
    return grid.label_union(ad.a3_fields(spark, sf_dir))


@query
def agg_first_per_label(spark, sf_dir):
    return grid.first_per_label(ad.a3_fields(spark, sf_dir))


@query
def agg_col_width(spark, sf_dir):
    cells, _ = _tab_grid(spark, sf_dir)
    return grid.column_widths(cells)


@query
def agg_review_summary(spark, sf_dir):
    return findings.review_summary(findings.timecard_findings(_a2_summary(spark, sf_dir)))


@query
def agg_doc_totals(spark, sf_dir):
    return totals.timecard_totals(_a2_summary(spark, sf_dir))


@query
def agg_doc_totals_payslip(spark, sf_dir):
    return totals.payslip_totals(ad.a3_summary(spark, sf_dir))


@query
def agg_confidence_stats(spark, sf_dir):
    read = word_sources.ocr_words(_ocr_rows(spark, sf_dir))
    stats = word_sources.confidence_stats(read, F.char_length("text") > 3)
    return stats.withColumn("p10_conf", F.round("p10_conf", 6))


@query
def agg_nest(spark, sf_dir):
    value = payslip.nest_payslips(_entries(spark, sf_dir, "F"))
    one = lambda p: F.concat_ws("/", p["page"].cast("string"), p["month"], p["year"], F.size(p["fields"]).cast("string"), F.size(p["bases"]).cast("string"))
    return value.select("doc_id", F.array_join(F.transform("value.pages", one), " ").alias("pages"))


# --- windows -------------------------------------------------------------------------------


@query
def find_date_break(spark, sf_dir):
    return findings.find_date_break(ad.a2_days(spark, sf_dir)).select("doc_id", "page_pos", "day_pos", "date_raw", "date_break")


@query
def find_month_break(spark, sf_dir):
    return findings.find_month_break(ad.a3_summary(spark, sf_dir)).select("doc_id", "entry_pos", "month", "year", "month_break")


@query
def find_tied_month(spark, sf_dir):
    """Damaged month names: the month taken, all it might be, and the findings of the entry."""
    words, pages = ad.render_month_names(spark, sf_dir)
    matched = transcribe.matched_lines(words, pages, (layouts.RECEIPT,))
    entries = payslip.number_entries(payslip.receipt_entries(matched, pages, month_ties=True))
    found = findings.payslip_findings(findings.summarise_nested_entries(entries, "month_ties"))
    return entries.select("doc_id", "entry_pos", "month", F.array_join("month_ties", "|").alias("month_ties")).join(
        found.select("doc_id", "entry_pos", F.array_join("codes", "|").alias("codes"), "severity"), ["doc_id", "entry_pos"]
    )


@query
def find_odd_punches(spark, sf_dir):
    return _a2_summary(spark, sf_dir).select("doc_id", "page_pos", "day_pos", findings.find_odd_punches(F.col("n_punches")).alias("odd"))


@query
def find_empty_page(spark, sf_dir):
    return ad.a3_summary(spark, sf_dir).select(
        "doc_id", "entry_pos", findings.find_empty_page(F.col("n_fields"), F.col("n_bases")).alias("empty")
    )


@query
def find_uncertain(spark, sf_dir):
    return _a2_summary(spark, sf_dir).select("doc_id", "page_pos", "day_pos", "marked")


@query
def severity(spark, sf_dir):
    found = findings.timecard_findings(_a2_summary(spark, sf_dir))
    return found.select("doc_id", "page_pos", "day_pos", F.array_join("codes", ",").alias("codes"), "severity")


@query
def payslip_severity(spark, sf_dir):
    found = findings.payslip_findings(ad.a3_summary(spark, sf_dir))
    return found.select("doc_id", "entry_pos", F.array_join("codes", ",").alias("codes"), F.array_join("reasons", " ").alias("reasons"), "severity")


@query
def severity_style(spark, sf_dir):
    found = findings.severity_style(findings.timecard_findings(_a2_summary(spark, sf_dir)))
    return found.groupBy("severity", "fill", "left_border").agg(F.count("*").alias("n"))


@query
def punch_ordinal(spark, sf_dir):
    return ad.a2_punches(spark, sf_dir).select("doc_id", "page_pos", "day_pos", "punch_pos", "kind", "time_raw", "time_hhmm")


@query
def field_ordinal(spark, sf_dir):
    return ad.a3_fields(spark, sf_dir).select("doc_id", "entry_pos", "field_pos", "code", "label", "reference", "value")


@query
def day_carry(spark, sf_dir):
    days, _ = _days(spark, sf_dir, "C")
    return timecard.flat_punches(days).select("doc_id", "page", "day_pos", "punch_pos", "kind", "time_hhmm")


@query
def block_id(spark, sf_dir):
    """Blocks of document lines, opened by lines whose first word is capitalised."""
    lines = _a1_lines(spark, sf_dir)
    opens = F.get("words", F.lit(0))["text"].rlike("^[A-Z]")
    cut = payslip.cut_blocks(lines, opens, F.col("text"))
    return cut.groupBy("doc_id", "page", "entry_no").agg(
        F.count("*").alias("n_lines"), F.max("_month").alias("opening_line")
    )


@query
def section_cut(spark, sf_dir):
    entries = _entries(spark, sf_dir, "M")
    return entries.select("doc_id", "page", F.size("fields").alias("n_fields"), F.size("bases").alias("n_bases"))


@query
def copy_cut(spark, sf_dir):
    return _entries(spark, sf_dir, "R").groupBy("doc_id").agg(
        F.count("*").alias("entries"), F.sum(F.size("fields")).alias("n_fields"), F.sum(F.size("bases")).alias("n_bases")
    )


@query
def year_lookahead(spark, sf_dir):
    matched, _ = _matched(spark, sf_dir, "R", (layouts.RECEIPT,))
    return payslip.fuzzy_months(matched).select("doc_id", "page", "year")


# --- order, top and set operations -------------------------------------------------------------


@query
def order_reading(spark, sf_dir):
    first = _a1_lines(spark, sf_dir).groupBy("doc_id", "page").agg(
        F.min_by("text", "line_no").alias("first_line"), F.max_by("text", "line_no").alias("last_line")
    )
    return first


@query
def order_in_line(spark, sf_dir):
    return geometry.assign_lines(ad.a1_words(spark, sf_dir)).groupBy("doc_id", "page", "line_pos").agg(
        F.count("*").alias("n"), F.sum("word_seq").alias("seqs")
    )


@query
def top1_header(spark, sf_dir):
    only = (layouts.RECEIPT,)
    matched, _ = _matched(spark, sf_dir, "R", only)
    return headers.detect_headers(matched, only).select("doc_id", "page", "header_line", "header_top", "score")


@query
def top1_layout(spark, sf_dir):
    scores, pages = _all_scores(spark, sf_dir)
    best = choice.select_layout(ad.rendered_documents(pages), scores)
    return best.groupBy("doc_type", "layout").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query
def first_competence_line(spark, sf_dir):
    matched, _ = _matched(spark, sf_dir, "C", (layouts.CONTINUATION,))
    month = matched.withColumn("m", timecard.page_month(fixed.MARK_MONTH_YEAR)).groupBy("doc_id", "page").agg(F.first("m").alias("m"))
    return month.select("doc_id", "page", F.coalesce("m.month", F.lit("")).alias("month"), F.coalesce("m.year", F.lit("")).alias("year"))


def _money_of_lines(spark, sf_dir, at):
    amounts = F.filter("texts", tok.is_money)
    return ad.a6_lines(spark, sf_dir).where(F.size(amounts) > 0).select("doc_id", "line_no", F.element_at(amounts, at).alias("value"))


@query
def first_money_in_line(spark, sf_dir):
    return _money_of_lines(spark, sf_dir, 1)


@query
def last_money_in_line(spark, sf_dir):
    return _money_of_lines(spark, sf_dir, -1)


@query
def union_sections(spark, sf_dir):
    return payslip.flat_bases(_entries(spark, sf_dir, "M")).select("doc_id", "page", "base_pos", "label", "value")


@query
def distinct_labels(spark, sf_dir):
    _, fields = _a3(spark, sf_dir)
    return grid.label_union(fields).select("doc_id", "label")


@query
def sorted_distinct_pages(spark, sf_dir):
    _, chosen, _ = _page_sources(spark, sf_dir)
    return chosen.where(F.col("source") == fixed.OCR).select("doc_id", "page").distinct().orderBy("doc_id", "page")


@query
def replace_pages(spark, sf_dir):
    _, chosen, delivered = _page_sources(spark, sf_dir)
    key = ["doc_id", "page"]
    return chosen.join(delivered.select(*key).withColumn("has_ocr", F.lit(True)), key, "left").select(
        *key, "n_words", F.when((F.col("source") == fixed.OCR) & F.col("has_ocr"), F.lit(fixed.OCR)).otherwise(F.lit(fixed.NATIVE)).alias("source")
    )


# --- scalar functions ------------------------------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    """Every document, with characters that stand for several put at its end."""
    full = F.concat("text", F.lit(" o\ufb01cial \u2116 \u00bd \U0001d400 \uac01"))
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.md5(txt.normalize_text(full)).alias("digest"))


@query
def read_clock(spark, sf_dir):
    c = tok.read_clock(F.col("token"))
    return ad.a2_log(spark, sf_dir).select("event_id", "token", c["raw"].alias("raw"), c["norm"].alias("norm"), c["uncertain"].alias("uncertain"))


def _amounts(spark, sf_dir):
    """Amounts of line items, whole and damaged in several ways."""
    k = F.col("l_orderkey") + F.col("l_partkey")
    amount = ad.brl(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    token = (
        F.when(k % 7 == 0, F.concat(F.lit("-"), amount))
        .when(k % 11 == 0, F.replace(amount, F.lit("1"), F.lit("l")))
        .when(k % 13 == 0, F.replace(amount, F.lit(","), F.lit(".")))
        .when(k % 17 == 0, F.concat(amount, F.lit(",")))
        .when(k % 19 == 0, F.concat(F.lit("R$"), amount))
        .otherwise(amount)
    )
    return ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", token.alias("token"))


@query
def read_money(spark, sf_dir):
    m = tok.read_money(F.col("token"))
    return _amounts(spark, sf_dir).select("l_orderkey", "l_partkey", "token", m["raw"].alias("raw"), F.coalesce(m["uncertain"], F.lit(False)).alias("uncertain"))


@query
def strict_money(spark, sf_dir):
    return _amounts(spark, sf_dir).select("l_orderkey", "token", tok.is_money(F.col("token")).alias("is_money"))


@query
def money_to_decimal(spark, sf_dir):
    return _amounts(spark, sf_dir).select("l_orderkey", "token", tok.money_to_decimal(F.col("token")).cast("double").alias("amount"))


@query
def read_competence_numeric(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Mes/Ano : "), (k % 15).cast("string"), F.when(k % 2 == 0, F.lit("/")).otherwise(F.lit(" / ")), F.year("o_orderdate").cast("string"))
    m = tok.read_month_year(text)
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", m["month"].alias("month"), m["year"].alias("year"))


@query
def read_competence_abbrev(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.get(F.array(*[F.lit(m) for m in ("jan", "FEV", "mar", "abr", "mai", "Jun", "xyz", "ago", "set", "out", "nov", "dez")]), (k % 12).cast("int"))
    year = F.when(k % 3 == 0, F.year("o_orderdate")).otherwise(F.year("o_orderdate") % 100 + 10).cast("string")
    m = tok.read_month_abbreviated(F.concat(F.lit("Mês:  "), name, F.lit("-"), year))
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", m["month"].alias("month"), m["year"].alias("year"))


@query
def read_competence_fuzzy(spark, sf_dir):
    matched, _ = _matched(spark, sf_dir, "R", (layouts.RECEIPT,))
    return payslip.fuzzy_months(matched)


@query
def compose_date(spark, sf_dir):
    k = F.col("o_orderkey")
    month = F.when(k % 5 != 0, F.struct(F.month("o_orderdate").cast("string").alias("month"), F.year("o_orderdate").cast("string").alias("year")))
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", tok.compose_date(F.dayofmonth("o_orderdate"), month).alias("date_raw"))


def _dates(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    damaged = (
        F.when(k % 11 == 0, F.concat(F.lit("3"), F.substr(text, F.lit(2))))
        .when(k % 13 == 0, F.concat(F.lit("?"), F.substr(text, F.lit(2))))
        .when(k % 17 == 0, F.substr(text, F.lit(1), F.lit(2)))
        .otherwise(text)
    )
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", damaged.alias("date_raw"))


@query
def date_shape(spark, sf_dir):
    return _dates(spark, sf_dir).select("o_orderkey", "date_raw", tok.date_shape(F.col("date_raw")).alias("shaped"))


@query
def parse_date(spark, sf_dir):
    return _dates(spark, sf_dir).select("o_orderkey", tok.parse_date(F.col("date_raw")).cast("string").alias("day"))


@query
def next_day(spark, sf_dir):
    return _dates(spark, sf_dir).select("o_orderkey", tok.next_day(tok.parse_date(F.col("date_raw"))).cast("string").alias("day"))


@query
def next_month(spark, sf_dir):
    after = tok.next_month(F.col("month"), F.col("year"))
    return ad.a3_entries(spark, sf_dir).select("o_orderkey", after["year"].alias("year"), after["month"].alias("month"))


@query
def split_interval(spark, sf_dir):
    e = F.col("event_id")
    clock, later = F.date_format("ts", "HH:mm"), F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "HH:mm")
    token = F.when(e % 3 == 0, F.concat(clock, F.lit("-"))).when(e % 3 == 1, F.concat(clock, F.lit("–"), later)).otherwise(clock)
    parts = tok.split_interval(token)
    return ad.table(spark, sf_dir, "events").select("event_id", F.size(parts).alias("n"), F.array_join(parts, "|").alias("parts"))


def _day_tokens(spark, sf_dir):
    e = F.col("event_id")
    number = (e % 40).cast("string")
    return ad.table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 3 == 0, F.concat(number, F.lit("QUA"))).when(e % 7 == 0, F.lit("SEG")).otherwise(number).alias("token")
    )


@query
def day_prefix(spark, sf_dir):
    return _day_tokens(spark, sf_dir).select("event_id", F.coalesce(tok.day_prefix(F.col("token")), F.lit(-1)).alias("day"))


@query
def day_digits(spark, sf_dir):
    return _day_tokens(spark, sf_dir).select("event_id", F.coalesce(tok.day_digits(F.col("token")), F.lit(-1)).alias("day"))


@query
def split_code(spark, sf_dir):
    k = F.col("p_partkey")
    token = F.when(k % 3 == 0, F.concat((k % 1500).cast("string"), F.col("p_type"))).when(k % 3 == 1, k.cast("string")).otherwise(F.col("p_type"))
    c = tok.split_code(token)
    return ad.table(spark, sf_dir, "part").select("p_partkey", token.alias("token"), c["code"].alias("code"), c["rest"].alias("rest"))


@query
def is_total_label(spark, sf_dir):
    k = F.col("p_partkey")
    label = F.when(k % 4 == 0, F.concat(F.lit("TOT. "), F.col("p_type"))).when(k % 4 == 1, F.concat(F.lit("Total"), F.col("p_type"))).when(k % 4 == 2, F.concat(F.lit("Tot "), F.col("p_type"))).otherwise(F.col("p_type"))
    return ad.table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), tok.is_total_label(label).alias("is_total"))


@query
def total_kind(spark, sf_dir):
    matched, _ = _matched(spark, sf_dir, "R", (layouts.RECEIPT,))
    kinds = tok.total_kinds(F.col("ntext"))
    return matched.where(F.size(kinds) > 0).select("doc_id", "page", "line_no", F.array_join(kinds, "|").alias("kinds"))


@query
def is_value_line(spark, sf_dir):
    """Whole lines with none to five amounts among five words."""
    lines = ad.mixed_lines(spark, sf_dir)
    return lines.select("doc_id", "line_no", F.size("texts").alias("n"), payslip.is_value_line(F.col("texts")).alias("is_values"))


@query
def px_to_points(spark, sf_dir):
    q = F.col("l_extendedprice")
    dpi = F.when(F.col("l_orderkey") % 2 == 0, 300).otherwise(200)
    return ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(tok.px_to_points(F.floor(q), dpi), 4).alias("points"))


@query
def cell_path(spark, sf_dir):
    cells, _ = _tab_grid(spark, sf_dir)
    return cells.select("doc_id", "path").where("path != ''")


# --- grids, review, lifecycle ------------------------------------------------------------------------


@query
def grid_timesheet(spark, sf_dir):
    return grid.timecard_grid(_a2_summary(spark, sf_dir), ad.a2_punches(spark, sf_dir))


@query
def grid_payslip(spark, sf_dir):
    entries, fields = _a3(spark, sf_dir)
    return grid.payslip_grid(entries, fields)


@query
def review_rows(spark, sf_dir):
    days, _ = _days(spark, sf_dir, "T")
    return grid.timecard_sheet(days).select(
        "doc_id", "page_pos", "day_pos", _joined(F.col("cells"), "value", "path").alias("cells"),
        "severity", F.array_join("reasons", " ").alias("reasons"),
    )


@query
def lifecycle_status(spark, sf_dir):
    return lifecycle.lifecycle_status(ad.a4_log(spark, sf_dir)).select(
        "id", "doc_type", "status", "error", "value", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    )


@query
def retention_expire(spark, sf_dir):
    """The store is written, what is expired removed from it, and the rest read back."""
    before = ad.a4_transcriptions(spark, sf_dir)
    path = session.fresh_path(spark)
    sinks.write_store(before.withColumn("source_path", F.lit(None).cast("string")), path)
    store.remove_expired(spark, path, datetime(2024, 1, 20, 6))
    left = store.read_store(spark, path).select("id", F.lit("kept").alias("left"))
    return before.join(left, "id", "left").select("id", "status", F.coalesce("left", F.lit("removed")).alias("outcome"))


@query
def bounded_intake(spark, sf_dir):
    """Uploads as a stream of two files of fifty a batch, each announced twice: every one is judged once."""
    path = session.fresh_path(spark)
    files = ad.a5_files(spark, sf_dir).withColumn("source_path", F.concat(F.lit("/uploads/"), "doc_id"))
    counts = files.select("source_path", "n_pages")
    named = files.select(
        "source_path", "length", "head", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id").cast("bigint") % 3600).alias("created_at")
    )
    named.unionByName(named).write.option("maxRecordsPerFile", 50).parquet(f"{path}/in")
    uploads = spark.readStream.schema(named.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    stream = streams.run_intake(uploads, "salt", f"{path}/out", f"{path}/state", counts, max_bytes=4000)
    stream.awaitTermination()
    judged = spark.read.parquet(f"{path}/out")
    sizes = judged.groupBy("batch").agg(F.count("*").alias("size"))
    return judged.join(sizes, "batch").groupBy(F.substring_index("source_path", "/", -1).alias("doc_id")).agg(
        F.count("*").alias("times"), F.first("verdict").alias("verdict"), F.first("error").alias("error"),
        (F.max("size") > 100).alias("over_bound"),
    )


@query
def compacted_corrections(spark, sf_dir):
    """The log of corrections in six batches, compacted after the third and the fifth, one batch written twice."""
    path = session.fresh_path(spark)
    edits = _corrections(spark, sf_dir)
    edits = edits.select("doc_id", "path", "new_value", "ts", F.pmod(F.xxhash64("doc_id", "path", "ts"), F.lit(6)).alias("n"))
    for n in (0, 1, 2, 2, 3, 4, 5):
        edits.where(F.col("n") == n).drop("n").write.mode("overwrite").parquet(f"{path}/batch={n}")
        if n in (2, 4):
            store.compact_corrections(spark, path)
    return store.read_corrections(spark, path).select("doc_id", "path", "new_value")


@query
def styled_sheet_header(spark, sf_dir):
    entries, fields = _a3(spark, sf_dir)
    return sinks.styled_header(grid.payslip_grid(entries, fields))

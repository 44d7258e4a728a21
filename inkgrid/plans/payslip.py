"""Payslip builders: lines to entries with fields and bases.

Each builder yields ``entries(doc_id, page, entry_no, year, month, fields,
bases)``; ``entry_no`` counts the entries of one page from 0, because several
months or sheets may share a page. Pages are the unit of work throughout.

By default receipts, blocks and ledgers take only amounts that are fully legible, so
there is nothing left to mark in them; the monthly sheet keeps any text of its amount
columns and marks what cannot be read. With ``strict=False`` every builder also takes
damaged amounts, in two passes: ``with_marked_amounts`` accepts words by their shape and
marks what is illegible, then the builder places them as it places legible ones.
``amount_balance`` shows that no amount got lost or was made up on the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.functions.bind import let, places
from inkgrid.functions.similarity import month_numbers, plausible_month
from inkgrid.functions.text import normalize_name, normalize_text
from inkgrid.functions.tokens import (
    is_money,
    is_money_shaped,
    is_total_label,
    marked_money,
    read_month_abbreviated,
    read_month_year,
    split_code,
    total_kinds,
)
from inkgrid.operators.geometry import (
    PAGE,
    cell_texts,
    group_cells,
    in_page,
    in_reading_order,
    label_value_pairs,
    move_lines,
    page_partitions,
    so_far,
)
from inkgrid.operators.findings import PAGES_PER_CHUNK
from inkgrid.operators.headers import with_header
from inkgrid.operators.scans import dense_position
from inkgrid.plans.layouts import BLOCKS, MONTHLY, RECEIPT
from inkgrid.plans.timecard import is_below_header

_FIELDS = "array<struct<code:string,label:string,reference:string,value:string>>"
_BASES = "array<struct<label:string,value:string>>"


def _no_fields() -> Column:
    return F.array().cast(_FIELDS)


def _no_bases() -> Column:
    return F.array().cast(_BASES)


def _field(code: Column, label: Column, reference: Column, value: Column) -> Column:
    return F.struct(
        code.alias("code"), label.alias("label"), reference.alias("reference"), value.alias("value")
    )


def _base(label: Column, value: Column) -> Column:
    return F.struct(label.alias("label"), value.alias("value"))


def _gather(lines: DataFrame, month: Column, *keys: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Month (and ``more`` of what comes with it), and fields and bases of the lines of an entry in reading order."""
    parts = F.array_sort(
        F.collect_list(
            F.when((F.size("f") > 0) | (F.size("b") > 0), F.struct("line_no", "f", "b"))
        )
    )
    return (
        lines.groupBy(*PAGE, *keys)
        .agg(month.alias("_m"), parts.alias("_p"))
        .select(
            *PAGE,
            *keys,
            "_m.year",
            "_m.month",
            *[F.col(f"_m.{name}").alias(name) for name in more],
            F.flatten(F.col("_p.f")).alias("fields"),
            F.flatten(F.col("_p.b")).alias("bases"),
        )
    )


def with_all_pages(entries: DataFrame, pages: DataFrame, *more: Column) -> DataFrame:
    """A page that gave no entry still has one, empty; ``more`` columns stay."""
    return (
        pages.select(*PAGE)
        .join(entries, list(PAGE), "left")
        .select(
            *PAGE,
            F.coalesce("entry_no", F.lit(0)).alias("entry_no"),
            F.coalesce("year", F.lit("")).alias("year"),
            F.coalesce("month", F.lit("")).alias("month"),
            F.coalesce("fields", _no_fields()).alias("fields"),
            F.coalesce("bases", _no_bases()).alias("bases"),
            *more,
        )
    )


# --- amounts ---------------------------------------------------------------


def amount_test(strict: bool) -> Callable[[Column], Column]:
    """What a builder takes for an amount."""
    return is_money if strict else is_money_shaped


def with_marked_amounts(matched: DataFrame, strict: bool = False) -> DataFrame:
    """Lines whose damaged amounts carry ``?`` at the illegible positions; unchanged when ``strict``."""
    if strict:
        return matched
    marked = F.transform("words", lambda w: w.withField("text", marked_money(w["text"])))
    return matched.withColumn("words", F.when(F.contains("text", F.lit(",")), marked).otherwise(F.col("words")))


def amount_balance(matched: DataFrame, entries: DataFrame, strict: bool = False) -> DataFrame:
    """``(doc_id, page, amount, n_read, n_kept)`` of every different amount of a page.

    ``n_read`` counts the words of ``matched`` that are amounts, ``n_kept`` those that ``entries`` hold as reference or
    value. What was read but not kept (a second copy, a line without a label) is the difference; it is never negative
    unless a builder makes amounts up. Both sides are reduced to one row per amount and page.
    """
    test = amount_test(strict)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    lines = with_marked_amounts(matched, strict).select(*PAGE, F.explode(F.filter(F.col("words.text"), test)).alias("amount"))
    held = F.concat("fields.reference", "fields.value", "bases.value")
    kept = entries.select(*PAGE, F.explode(F.filter(held, test)).alias("amount"))
    both = lines.select("*", one.alias("r"), none.alias("k")).unionByName(kept.select("*", none.alias("r"), one.alias("k")))
    return both.groupBy(*PAGE, "amount").agg(F.sum("r").alias("n_read"), F.sum("k").alias("n_kept"))


# --- monthly ---------------------------------------------------------------


def _monthly_field(cells: Column) -> Column:
    label, earned = F.get(cells, F.lit(1)), F.get(cells, F.lit(3))
    value = F.coalesce(F.nullif(earned, F.lit("")), F.get(cells, F.lit(4)))
    return let(
        value,
        lambda v: F.when(
            (label != "") & (v != ""),
            F.array(_field(F.get(cells, F.lit(0)), label, F.get(cells, F.lit(2)), marked_money(v))),
        ),
    )


def _monthly_base(texts: Column, cells: Column, money: Callable[[Column], Column]) -> Column:
    first = F.col("_first")
    totals = F.array_compact(
        F.array(
            *[
                F.when(
                    money(F.get(cells, F.lit(k))),
                    _base(F.lit(f"Total {MONTHLY.titles[k]}"), F.get(cells, F.lit(k))),
                )
                for k in (3, 4)
            ]
        )
    )
    net = let(
        F.get(F.filter(texts, money), F.lit(0)),
        lambda amount: F.when(amount.isNotNull(), F.array(_base(F.get(cells, F.lit(0)), amount))),
    )
    return (
        F.when(F.startswith(first, F.lit(fixed.MARK_TOTAL)), totals)
        .when(F.startswith(first, F.lit(fixed.MARK_NET)), net)
        .otherwise(label_value_pairs(texts, money))
    )


def monthly_entries(matched: DataFrame, pages: DataFrame, strict: bool = True) -> DataFrame:
    """Fields above the total line, bases from it on; one entry per page.

    Lines that give nothing stay until the page is gathered: the month is kept
    even when the page has no table.
    """
    marker = F.when(F.contains("ntext", F.lit(fixed.PRINT_MONTHLY)), F.col("line_no"))
    total = F.when(
        F.startswith("_first", F.lit(fixed.MARK_TOTAL)) & F.col("_below"), F.col("line_no")
    )
    lines = (
        with_header(with_marked_amounts(matched, strict), MONTHLY)
        .withColumn("_below", is_below_header())
        .withColumn("_cells", F.when(F.col("_below"), cell_texts(F.col("words"), F.col("header.cols"))))
        .withColumn("_first", normalize_text(F.get("_cells", F.lit(0))))
        .withColumn("_cut", F.min(total).over(in_page()))
        .withColumn("_is_base", F.coalesce(F.col("line_no") >= F.col("_cut"), F.lit(False)))
    )
    cells, texts = F.col("_cells"), F.col("words.text")
    field = F.when(F.col("_below") & ~F.col("_is_base"), _monthly_field(cells))
    base = F.when(F.col("_below") & F.col("_is_base"), _monthly_base(texts, cells, amount_test(strict)))
    read = lines.select(
        *PAGE,
        "line_no",
        "text",
        marker.alias("_marker"),
        F.coalesce(field, _no_fields()).alias("f"),
        F.coalesce(base, _no_bases()).alias("b"),
    )
    month = read_month_year(F.min_by("text", "_marker"), two_digits=True)
    return with_all_pages(_gather(read, month).withColumn("entry_no", F.lit(0)), pages)


# --- receipt ---------------------------------------------------------------


def with_named_month(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``named``: the month a line names despite damaged letters, NULL on most lines.

    The first word close enough to a month name counts. Of several month names it is equally close to the first of
    the calendar is taken; ``named.tied`` lists all of them, and is empty where one name wins. The year is glued with
    ``/`` or is the first four-digit word among the next three, which may stand
    on following lines. Only lines with a plausible word travel to Python. Lines move by page into ``partitions`` parts.
    """
    # Python first: it loses the partitioning by page, which the windows ask for, so lines move once after titles and months
    asked = move_lines(lines.withColumn("_numbers", month_numbers(_asked_names())), partitions)
    return _named(asked.withColumn("_ahead", _words_ahead())).drop("_numbers", "_ahead")


def _name_of(word: Column) -> Column:
    return F.substring_index(word, "/", 1)


def _asked_names() -> Column:
    """What may be a month name among the words of a line, NULL for the others; NULL for a line without any."""
    tried = F.transform(
        "words.text",
        lambda t: let(normalize_name(_name_of(t)), lambda n: F.when(plausible_month(n), n)),
    )
    return let(tried, lambda names: F.when(F.exists(names, lambda n: n.isNotNull()), names))


def _words_ahead() -> Column:
    """The first three words of each of the next three lines."""
    none = F.array().cast("array<string>")
    start = F.slice(F.col("words.text"), 1, 3)
    return F.concat(*[F.coalesce(F.lead(start, k).over(in_reading_order()), none) for k in (1, 2, 3)])


def _named(lines: DataFrame) -> DataFrame:
    """Add ``named`` from ``_numbers`` and ``_ahead``."""
    hits = lines.withColumn("_at", F.get(places(F.col("_numbers"), lambda m: m.isNotNull()), F.lit(0)))
    texts, at = F.col("words.text"), F.col("_at")
    rest = let(F.get(texts, at), lambda t: F.substr(t, F.char_length(_name_of(t)) + 2))
    following = F.slice(F.concat(F.slice(texts, at + 2, F.lit(3)), F.col("_ahead")), 1, 3)
    later = F.get(
        F.filter(
            F.transform(following, lambda t: F.regexp_replace(t, "^/+|/+$", "")),
            lambda t: t.rlike("^[0-9]{4}$"),
        ),
        F.lit(0),
    )
    year = let(rest, lambda r: F.when(r.rlike("^[0-9]{4}$"), r).otherwise(F.coalesce(later, F.lit(""))))
    winners = F.transform(F.get("_numbers", at), lambda n: F.lpad(n.cast("string"), 2, "0"))
    tied = lambda w: F.when(F.size(w) > 1, w).otherwise(F.array().cast("array<string>"))
    struct = let(winners, lambda w: F.struct(F.get(w, F.lit(0)).alias("month"), year.alias("year"), tied(w).alias("tied")))
    named = F.when(at.isNotNull(), struct)
    return hits.withColumn("named", named).drop("_at")


def fuzzy_months(lines: DataFrame) -> DataFrame:
    """Month named on each page; one row per page that names one."""
    asked = lines.withColumn("_ahead", _words_ahead()).withColumn("_asked", _asked_names()).where("_asked IS NOT NULL")
    named = _named(asked.withColumn("_numbers", month_numbers(F.col("_asked"))))
    # lines without a month go after the groups: a filter on them would ask Python a second time
    return (
        named.groupBy(*PAGE)
        .agg(F.min_by("named", F.when(F.col("named").isNotNull(), F.col("line_no"))).alias("m"))
        .where("m IS NOT NULL")
        .select(*PAGE, "m.month", "m.year")
    )


def _receipt_row(cells: Column, ordinal: int, money: Callable[[Column], Column]) -> Column:
    label, quantity, value = (F.get(cells, F.lit(ordinal + k)) for k in range(3))
    # text without a digit in the quantity column is the end of a long label
    spilled = (quantity != "") & ~quantity.rlike("[0-9]")
    whole = F.when(spilled, F.trim(F.concat_ws(" ", label, quantity))).otherwise(label)
    kept = F.when(spilled, F.lit("")).otherwise(quantity)
    return F.when(
        (whole != "") & money(value), _field(F.lit(""), whole, kept, value)
    )


def _receipt_totals(texts: Column, money: Callable[[Column], Column]) -> Column:
    """Totals of a line: names in configured order, amounts left to right, up to the shorter."""
    names = F.col("_kinds")
    return let(
        F.filter(texts, money),
        lambda amounts: F.transform(
            F.slice(names, F.lit(1), F.least(F.size(names), F.size(amounts))),
            lambda name, i: _base(name, F.get(amounts, i)),
        ),
    )


def _stacked_bases(words: Column, above: Column, money: Callable[[Column], Column]) -> Column:
    """Each amount takes the nearest cell of the line above; the leftmost of equals."""

    def nearest(word: Column, cells: Column) -> Column:
        best = F.array_min(
            F.transform(
                cells,
                lambda c, i: F.struct(
                    F.abs(c["centre"] - word["cx"]).alias("d"), i.alias("i"), c["label"].alias("label")
                ),
            )
        )
        return _base(best["label"], word["text"])

    amounts = F.filter(words, lambda w: money(w["text"]))
    return let(
        group_cells(above),
        lambda cells: F.filter(
            F.transform(amounts, lambda w: nearest(w, cells)), lambda b: b["label"] != ""
        ),
    )


def is_value_line(texts: Column, money: Callable[[Column], Column] = is_money) -> Column:
    return let(
        F.size(F.filter(texts, money)), lambda n: (n >= 3) & (n >= F.size(texts) - 2)
    )


def receipt_entries(matched: DataFrame, pages: DataFrame, strict: bool = True, month_ties: bool = False) -> DataFrame:
    """Two copies per page, two tables side by side, bases stacked under their labels.

    ``month_ties`` adds an array of that name: the month names between which the printed one cannot decide, for
    ``findings.payslip_findings``.
    """
    money = amount_test(strict)
    copy = F.when(
        F.contains("ntext", F.lit(fixed.PRINT_RECEIPT)) & F.col("_below"), F.struct("line_no", "top")
    )
    before = in_reading_order().rowsBetween(Window.unboundedPreceding, -1)
    total = F.when(F.col("_is_total"), F.col("line_no"))
    lines = (
        with_header(with_named_month(with_marked_amounts(matched, strict), page_partitions(pages)), RECEIPT)
        .withColumn("_below", is_below_header())
        .withColumn("_cut", F.min(copy).over(in_page())["top"])
        .withColumn(
            "_kept", F.col("_below") & (F.col("_cut").isNull() | (F.col("top") < F.col("_cut")))
        )
        .withColumn("_kinds", total_kinds(F.col("ntext")))
        .withColumn("_is_total", F.col("_kept") & (F.size("_kinds") > 0))
        .withColumn("_total", F.min(total).over(in_page()))
        .withColumn("_above", F.last(F.when(F.col("_kept"), F.col("words")), True).over(before))
        .withColumn("_is_field", F.col("_kept") & F.coalesce(F.col("line_no") < F.col("_total"), F.lit(True)))
        .withColumn("_cells", F.when(F.col("_is_field"), cell_texts(F.col("words"), F.col("header.cols"))))
    )
    texts, cells = F.col("words.text"), F.col("_cells")
    field = F.when(
        F.col("_is_field"), F.array_compact(F.array(_receipt_row(cells, 0, money), _receipt_row(cells, 3, money)))
    )
    base = F.when(F.col("_is_total"), _receipt_totals(texts, money)).when(
        F.col("_kept") & F.col("_above").isNotNull() & is_value_line(texts, money),
        _stacked_bases(F.col("words"), F.col("_above"), money),
    )
    read = lines.select(
        *PAGE,
        "line_no",
        "named",
        F.coalesce(field, _no_fields()).alias("f"),
        F.coalesce(base, _no_bases()).alias("b"),
    )
    month = F.min_by("named", F.when(F.col("named").isNotNull(), F.col("line_no")))
    gathered = _gather(read, month, more=("tied",)).withColumn("entry_no", F.lit(0))
    ties = F.coalesce("tied", F.array().cast("array<string>")).alias("month_ties")
    return with_all_pages(gathered, pages, *[ties] if month_ties else [])


# --- blocks and ledger -----------------------------------------------------


def cut_blocks(lines: DataFrame, opens: Column, month: Column) -> DataFrame:
    """Number the blocks of a page; lines before the first are dropped.

    Adds ``entry_no`` and the ``_month`` read from the opening line; the opening
    line itself stays, flagged ``_opens``.
    """
    return (
        lines.withColumn("_opens", opens)
        .withColumn("entry_no", F.sum(F.col("_opens").cast("int")).over(so_far()).cast("int") - 1)
        .where(F.col("entry_no") >= 0)
        .withColumn("_month", F.when(F.col("_opens"), month))
    )


def _block_entries(blocks: DataFrame, field: Column, base: Column, pages: DataFrame) -> DataFrame:
    read = blocks.select(
        *PAGE,
        "entry_no",
        "line_no",
        "_month",
        F.coalesce(F.when(~F.col("_opens"), field), _no_fields()).alias("f"),
        F.coalesce(F.when(~F.col("_opens"), base), _no_bases()).alias("b"),
    )
    return with_all_pages(_gather(read, F.max("_month"), "entry_no"), pages)


def _block_field(words: Column, cols: Column, money: Callable[[Column], Column]) -> Column:
    """``code name... [reference] value``; the value is the last amount of the line."""
    texts = words["text"]

    def build(at: Column) -> Column:
        count = F.size(at)
        ref_at = F.when(count >= 2, F.get(at, count - 2))
        end = F.coalesce(ref_at, F.get(at, count - 1))
        # textual reference: lies in the base column, left of the only amount
        textual = ref_at.isNull() & (end > 1) & let(
            F.struct(F.get(words, end - 1)["cx"].alias("cx"), F.get(cols, F.lit(2)).alias("c")),
            lambda v: F.coalesce(
                (v["cx"] >= v["c"]["x0"]) & (v["cx"] < v["c"]["x1"]), F.lit(False)
            ),
        )
        found = F.struct(
            F.get(at, count - 1).alias("value_at"), ref_at.alias("ref_at"), end.alias("end"), textual.alias("textual")
        )
        return let(found, finish)

    def finish(v: Column) -> Column:
        size = v["end"] - 1 - F.when(v["textual"], F.lit(1)).otherwise(F.lit(0))
        label = F.trim(F.array_join(F.slice(texts, F.lit(2), F.greatest(size, F.lit(0))), " "))
        reference = F.coalesce(
            F.get(texts, v["ref_at"]), F.when(v["textual"], F.get(texts, v["end"] - 1)), F.lit("")
        )
        return let(
            label,
            lambda t: F.when(
                t != "",
                F.array(
                    _field(F.get(texts, F.lit(0)), t, reference, F.get(texts, v["value_at"]))
                ),
            ),
        )

    return F.when(
        F.get(texts, F.lit(0)).rlike(fixed.CODE3),
        let(places(texts, money), lambda at: F.when(F.size(at) > 0, build(at))),
    )


def block_entries(matched: DataFrame, pages: DataFrame, strict: bool = True) -> DataFrame:
    """Blocks opened by the month line; a field is a line that starts with a three-digit code."""
    money = amount_test(strict)
    blocks = cut_blocks(
        with_header(with_marked_amounts(matched, strict), BLOCKS),
        F.contains("ntext", F.lit(fixed.MARK_MONTH_YEAR)),
        read_month_year(F.col("text"), two_digits=True),
    )
    texts = F.col("words.text")
    base = F.when(
        ~F.get(texts, F.lit(0)).rlike(fixed.CODE3), label_value_pairs(texts, money)
    )
    return _block_entries(blocks, _block_field(F.col("words"), F.col("header.cols"), money), base, pages)


def code_cut(lines: DataFrame) -> DataFrame:
    """Where the deduction codes begin, per document: upper median of their left edges, less 5.

    The discrete percentile is taken in descending order, which picks the upper
    of two middles, and merges partial counts of distinct positions: a large
    document is reduced before it is shuffled. Fewer than three codes give none.
    """
    codes = lines.select("doc_id", F.explode("words").alias("w")).where(F.col("w.text").rlike(fixed.CODE3))
    return (
        codes.select("doc_id", F.col("w.x0").alias("x0"))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n"),
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x0 DESC)").alias("mid"),
        )
        .where(F.col("n") >= 3)
        .select("doc_id", (F.col("mid") - 5.0).alias("cut"))
    )


def split_groups(words: Column, cut: Column, money: Callable[[Column], Column] = is_money) -> Column:
    """Earnings, deductions and results of a line.

    Earnings end at the code column; results begin at the first word starting
    with a letter after the first amount of the remainder.
    """
    def divide(rest: Column) -> Column:
        amount = F.get(places(rest["text"], money), F.lit(0))
        opening = let(
            amount,
            lambda a: F.get(
                F.filter(places(rest["text"], lambda t: t.rlike(r"^\p{L}")), lambda i: i > a), F.lit(0)
            ),
        )
        return let(
            F.coalesce(opening, F.size(rest)),
            lambda size: F.struct(
                F.filter(words, lambda w: w["x0"] < cut)["text"].alias("earned"),
                F.slice(rest["text"], F.lit(1), size).alias("deducted"),
                F.slice(rest["text"], size + 1, F.size(rest)).alias("result"),
            ),
        )

    return let(F.filter(words, lambda w: w["x0"] >= cut), divide)


def read_record(texts: Column, money: Callable[[Column], Column] = is_money) -> Column:
    """``[code] label [reference] value`` of one group, or NULL."""

    def body(value_at: Column, first: Column) -> Column:
        return F.concat(
            F.filter(F.array(first["rest"]), lambda t: t != ""),
            F.slice(texts, F.lit(2), F.greatest(value_at - 1, F.lit(0))),
        )

    def finish(value_at: Column, first: Column, parts: Column) -> Column:
        last = F.get(parts, F.size(parts) - 1)
        damaged = money(last) & F.translate(last, "?", "0").rlike(fixed.REFERENCE)
        referenced = F.coalesce(last.rlike(fixed.REFERENCE) | damaged, F.lit(False))
        return let(
            referenced,
            lambda r: let(
                F.trim(
                    F.array_join(
                        F.slice(parts, F.lit(1), F.size(parts) - F.when(r, F.lit(1)).otherwise(F.lit(0))), " "
                    )
                ),
                lambda label: F.when(
                    label != "",
                    _field(
                        first["code"],
                        label,
                        F.when(r, last).otherwise(F.lit("")),
                        F.get(texts, value_at),
                    ),
                ),
            ),
        )

    def build(value_at: Column) -> Column:
        # an amount in first place has no label before it
        return F.when(
            value_at > 0,
            let(
                split_code(F.get(texts, F.lit(0))),
                lambda first: let(
                    body(value_at, first), lambda parts: finish(value_at, first, parts)
                ),
            ),
        )

    return let(F.element_at(F.concat(F.array(F.lit(-1)), places(texts, money)), -1), build)


def ledger_entries(matched: DataFrame, pages: DataFrame, strict: bool = True) -> DataFrame:
    """Several months per page, three groups per line, totals moved to the bases."""
    # The cut is one number per document; it is first joined to the small page
    # table and reaches the lines by page key, where they already are.
    money = amount_test(strict)
    cuts = pages.select(*PAGE).join(code_cut(matched), "doc_id")
    lines = with_marked_amounts(matched, strict).join(cuts, list(PAGE))
    blocks = cut_blocks(
        lines,
        F.startswith("ntext", F.lit(fixed.MARK_MONTH)),
        read_month_abbreviated(F.col("text")),
    ).where(F.col("_opens") | ~F.startswith("ntext", F.lit(fixed.MARK_SHEET)))
    records = (
        blocks.withColumn("_g", split_groups(F.col("words"), F.col("cut"), money))
        .withColumn("_e", read_record(F.col("_g.earned"), money))
        .withColumn("_d", read_record(F.col("_g.deducted"), money))
        .withColumn("_r", read_record(F.col("_g.result"), money))
    )
    two = F.array_compact(F.array("_e", "_d"))
    field = F.filter(two, lambda r: ~is_total_label(r["label"]))
    totals = F.filter(two, lambda r: is_total_label(r["label"]))
    base = F.transform(
        F.concat(totals, F.array_compact(F.array("_r"))), lambda r: _base(r["label"], r["value"])
    )
    return _block_entries(records, field, base, pages)


# --- flat and nested forms -------------------------------------------------


def flat_fields(entries: DataFrame) -> DataFrame:
    return entries.select(
        *PAGE, "entry_no", F.posexplode("fields").alias("field_pos", "f")
    ).select(*PAGE, "entry_no", "field_pos", "f.*")


def flat_bases(entries: DataFrame) -> DataFrame:
    return entries.select(
        *PAGE, "entry_no", F.posexplode("bases").alias("base_pos", "b")
    ).select(*PAGE, "entry_no", "base_pos", "b.*")


def nest_payslips(entries: DataFrame) -> DataFrame:
    """``(doc_id, value)``; at most fifty printed pages per document."""
    one = F.struct("page", "entry_no", "year", "month", "fields", "bases")
    ordered = F.array_sort(F.collect_list(one))
    pages = F.transform(
        ordered, lambda e: F.struct(*[e[k].alias(k) for k in ("page", "year", "month", "fields", "bases")])
    )
    return entries.groupBy("doc_id").agg(F.struct(pages.alias("pages")).alias("value"))


def number_entries(entries: DataFrame) -> DataFrame:
    """Add ``entry_pos``, the index of the entry in its document's value."""
    return dense_position(
        entries,
        ["doc_id"],
        ["page", "entry_no"],
        F.floor(F.col("page") / PAGES_PER_CHUNK),
        "entry_pos",
    )

"""From words with boxes to visual lines and cells.

Everything here is local to one printed page, so ``(doc_id, page)`` is the
partitioning of the word stream: a document with many pages spreads over the
cluster, and every later window or group on a page, line or block reuses the
same exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.functions.bind import let, places
from inkgrid.functions.text import normalize_text, normalize_word

PAGE = ("doc_id", "page")


def in_page() -> WindowSpec:
    return Window.partitionBy(*PAGE)


def in_reading_order() -> WindowSpec:
    return in_page().orderBy("line_no")


def so_far() -> WindowSpec:
    return in_reading_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


#: Pages whose words are parted in one task. Packed words grow about twentyfold there: partitions measured by their bytes in
#: the shuffle spill.
PAGES_PER_TASK = 8192


def page_partitions(pages: DataFrame, per_task: int = PAGES_PER_TASK) -> int:
    """Partitions of the words: their number follows the pages, so that the words held by one task stay in its memory.

    Never fewer than the session's shuffle partitions: in a join the side with fewer would move, and that is not the pages.
    """
    spark = pages.sparkSession
    least = max(spark.sparkContext.defaultParallelism, _session_partitions(spark))
    return max(least, math.ceil(pages.count() / per_task))


def _session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Words folded at a time when a segment is cut into lines: what grows while folding stays this short.
_BLOCK = 256


def _tolerance(heights: Column, tolerance: float | None) -> Column:
    """How far a word's centre may lie from the line's first: given, or 0.6 of the median of the page's ``heights``."""
    if tolerance is not None:
        return F.lit(float(tolerance))

    def middle(up: Column) -> Column:
        # as ``median`` does: halfway between the two in the middle
        return F.get(up, F.floor((F.size(up) - 1) / 2).cast("int")) * 0.5 + F.get(up, F.floor(F.size(up) / 2).cast("int")) * 0.5

    return F.greatest(F.lit(2.0), F.coalesce(let(F.sort_array(heights), middle) * 0.6, F.lit(0.0)))


def _openings(centres: Column, limit: Column) -> Column:
    """Places (from 0) at which segments start among ascending centres: where two neighbours are further apart than the limit."""
    gap = lambda i: F.get(centres, i) - F.get(centres, i - 1)
    return F.filter(F.sequence(F.lit(0), F.size(centres) - 1), lambda i: F.coalesce(gap(i) > limit, F.lit(True)))


def _starts(centres: Column, tolerance: Column) -> Column:
    """Places (from 0) at which lines start among ascending centres: each where the last start is left behind.

    The only walk with a memory, so a fold; it runs over blocks, so that no long array is copied at each step.
    """
    none = F.array().cast("array<int>")

    def state(ref: Column, at: Column, starts: Column) -> Column:
        return F.struct(ref.alias("ref"), at.alias("at"), starts.alias("starts"))

    def step(s: Column, centre: Column) -> Column:
        leaves = s["ref"].isNull() | (centre - s["ref"] > tolerance)
        following = state(centre, s["at"] + 1, F.concat(s["starts"], F.array(s["at"])))
        return F.when(leaves, following).otherwise(state(s["ref"], s["at"] + 1, s["starts"]))

    def block(s: Column, part: Column) -> Column:
        def kept(end: Column) -> Column:
            return F.struct(
                end["ref"].alias("ref"), end["at"].alias("at"), F.concat(s["parts"], F.array(end["starts"])).alias("parts")
            )

        return let(F.aggregate(part, state(s["ref"], s["at"], none), step), kept)

    blocks = F.transform(
        F.sequence(F.lit(1), F.size(centres), F.lit(_BLOCK)), lambda first: F.slice(centres, first, F.lit(_BLOCK))
    )
    start = F.struct(
        F.lit(None).cast("double").alias("ref"), F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts")
    )
    return F.aggregate(blocks, start, block, lambda end: F.flatten(end["parts"]))


def _line(items: Column) -> Column:
    members = items["member"]
    return F.struct(
        F.array_min(members["top"]).alias("top"), F.array_max(members["bottom"]).alias("bottom"),
        F.sort_array(members).alias("members"),
    )


def _parts(down: Column, at: Column, part: Callable[[Column], Column]) -> Column:
    """``part`` of the items from each place ``at`` (from 0) to the next."""
    return F.transform(
        at, lambda first, k: part(F.slice(down, first + 1, F.coalesce(F.get(at, k + 1), F.size(down)) - first))
    )


def _lines(down: Column, limit: Column) -> Column:
    """The lines of a page's words, which are sorted by centre: lists of lines, one for each segment."""

    def cut(items: Column) -> Column:
        # a segment taller than the tolerance, from top to bottom
        return let(_starts(items["cy"], limit), lambda at: _parts(items, at, _line))

    def lines(items: Column) -> Column:
        height = F.get(items, F.size(items) - 1)["cy"] - F.get(items, F.lit(0))["cy"]
        return F.when(height > limit, cut(items)).otherwise(F.array(_line(items)))

    return let(let(down["cy"], lambda centres: _openings(centres, limit)), lambda at: _parts(down, at, lambda part: let(part, lines)))


#: Stands between the texts of a list that travels as one text; lists with a text that holds it travel as they are.
_BORDER = " "


def _one_text(texts: Column) -> Column:
    """The texts with ``_BORDER`` between them; NULL if a text is NULL or holds it."""
    # a NULL brings a border more, as does a text that holds one
    joined = F.array_join(texts, _BORDER, _BORDER)
    borders = F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(_BORDER), F.lit("")))
    return F.when(borders == F.size(texts) - 1, joined)


def _many_texts(joined: Column, texts: Column) -> Column:
    """What ``_one_text`` was made of; ``texts`` where it is NULL."""
    return F.coalesce(F.split(joined, _BORDER, -1), texts)


def page_runs(words: DataFrame) -> DataFrame:
    """Neighbouring words of one page as one row: the page, and a list for each other column, in the same order.

    A page may have several runs, which do not depend on the order of the words for their whole. As columns, with the texts
    of a run as one, words take a third of the bytes in a shuffle that they take as rows.
    """
    rest = [field for field in words.schema if field.name not in PAGE]
    runs_of = T.StructType(
        [words.schema[name] for name in PAGE] + [T.StructField(field.name, T.ArrayType(field.dataType)) for field in rest]
    )
    keys, names = list(PAGE), [field.name for field in rest]

    def in_runs(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def starts(batch: pa.RecordBatch) -> np.ndarray:
            opens = np.zeros(batch.num_rows, bool)
            opens[0] = True
            for key in map(batch.column, keys):
                # NULL against anything is taken for another page: the group puts the runs together
                other = pc.fill_null(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)), True)
                opens[1:] |= other.to_numpy(zero_copy_only=False)
            return np.flatnonzero(opens)

        for batch in batches:
            if not batch.num_rows:
                continue
            at = starts(batch)
            if 4 * len(at) > batch.num_rows:
                # words of many pages by turns
                batch = batch.sort_by([(key, "ascending") for key in keys])
                at = starts(batch)
            borders = pa.array(np.append(at, batch.num_rows), pa.int32())
            lists = [pa.ListArray.from_arrays(borders, batch.column(name)) for name in names]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)) for key in keys] + lists, names=keys + names)

    return words.select(*keys, *names).mapInArrow(in_runs, runs_of)


def move_lines(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same lines, partitioned by page. Their words move as columns, the texts of a line as one."""
    fields = lines.schema["words"].dataType.elementType.fields
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    words = F.col("words")
    told = []
    for f in fields:
        if f.name in texts:
            told.append(_one_text(words[f.name]).alias(f"_joined_{f.name}"))
            told.append(F.when(_one_text(words[f.name]).isNull(), words[f.name]).alias(f"_texts_{f.name}"))
        else:
            told.append(words[f.name].alias(f"_list_{f.name}"))
    rest = [c for c in lines.columns if c != "words"]
    parts = partitions or _session_partitions(lines.sparkSession)
    moved = lines.select(*rest, *told).repartition(parts, *PAGE)
    lists = [
        _many_texts(F.col(f"_joined_{f.name}"), F.col(f"_texts_{f.name}")) if f.name in texts else F.col(f"_list_{f.name}")
        for f in fields
    ]
    lists = [column.alias(f.name) for column, f in zip(lists, fields)]
    return moved.select(*rest, F.arrays_zip(*lists).alias("words")).select(*lines.columns)


def _page_rows(words: DataFrame, partitions: int | None) -> DataFrame:
    """One row a page: for each other column the list of all its words, in equal order. Runs of words are what moves."""
    rest = [field for field in words.schema if field.name not in PAGE]
    texts = [field.name for field in rest if isinstance(field.dataType, T.StringType)]
    runs = page_runs(words)
    # joined by compiled code below the groups: an aggregate of lists interprets whatever it is given
    told = [
        F.struct(_one_text(F.col(c)).alias("joined"), F.when(_one_text(F.col(c)).isNull(), F.col(c)).alias("texts")).alias(c)
        if c in texts else F.col(c) for c in (field.name for field in rest)
    ]
    parts = partitions or _session_partitions(words.sparkSession)
    moved = runs.select(*PAGE, F.struct(*told).alias("_member")).repartition(parts, *PAGE)
    pages = moved.groupBy(*PAGE).agg(F.collect_list("_member").alias("_members"))

    def whole(c: str) -> Column:
        if c not in texts:
            return F.flatten(F.col("_members")[c])
        return F.flatten(F.transform("_members", lambda m: _many_texts(m[c]["joined"], m[c]["texts"])))

    return pages.select(*PAGE, *[whole(field.name).alias(field.name) for field in rest])


def _grouped(words: DataFrame, tolerance: float | None, extra: list[str], partitions: int | None) -> DataFrame:
    """``(doc_id, page, line_no, top, bottom, members)``: words of each visual line from left to right.

    A line holds the words whose centre lies within the tolerance of the line's first word. Words sorted by centre open a
    line wherever two neighbours are further apart than the tolerance, whatever the reference is: a segment runs from one
    such opening to the next. A segment no taller than the tolerance is one line; only taller ones, where lines touch, are
    cut by a fold over their words. Members start with ``x0, cy, word_seq, top, bottom``, their order, and carry ``extra``.

    Runs of words move, once; a page is collected and parted in its row: words are neither sorted by Spark nor grouped again
    by line.
    """
    pages = _page_rows(words, partitions).withColumn("cy", F.zip_with("top", "bottom", lambda t, b: (t + b) / 2))
    pages = pages.withColumn("member", F.arrays_zip("x0", "cy", "word_seq", "top", "bottom", *extra))
    heights = F.filter(F.zip_with("top", "bottom", lambda t, b: (b - t).cast("double")), lambda h: h > 0)
    down = F.sort_array(F.arrays_zip("cy", "x0", "word_seq", "member"))
    lines = let(_tolerance(heights, tolerance), lambda limit: let(down, lambda down: F.flatten(_lines(down, limit))))
    return pages.select(*PAGE, F.posexplode(lines).alias("line_no", "_line")).select(*PAGE, "line_no", "_line.*")


def assign_lines(words: DataFrame, tolerance: float | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``line_no`` (from 0) and ``line_pos``, the place in the line from left to right, to every word.

    Words move by page into ``partitions`` parts, the session's number if not given.
    """
    rest = [c for c in words.columns if c not in (*PAGE, "x0", "word_seq", "top", "bottom")]
    placed = _grouped(words, tolerance, rest, partitions).select(
        *PAGE, "line_no", F.posexplode("members").alias("line_pos", "_word")
    )
    own = [c if c in PAGE else F.col("_word")[c].alias(c) for c in words.columns]
    return placed.select(*own, "line_no", "line_pos")


def build_lines(words: DataFrame, tolerance: float | None = None, partitions: int | None = None) -> DataFrame:
    """One row per visual line: bounds, text, accent-free text, ordered words. ``partitions`` as in ``assign_lines``."""
    narrow = words.select(*PAGE, "word_seq", "text", "x0", "x1", "top", "bottom")
    return (
        _grouped(narrow, tolerance, ["x1", "text"], partitions)
        .select(*PAGE, "line_no", "top", "bottom", *[F.col(f"members.{c}").alias(c) for c in ("text", "x0", "x1")])
        .withColumn("norm", _normalized(F.col("text")))
        .withColumn("cx", F.zip_with("x0", "x1", lambda a, b: (a + b) / 2))
        .withColumn("words", F.arrays_zip("text", "norm", "x0", "x1", "cx"))
        .withColumn("text", F.array_join("text", " "))
        .withColumn("ntext", normalize_text(F.col("text")))
        .select(*PAGE, "line_no", "top", "bottom", "words", "text", "ntext")
    )


def _normalized(texts: Column) -> Column:
    """``normalize_word`` of each text; in plain ASCII without blanks, which most lines are, the line is folded as one."""
    # a NULL comes apart as two, as does a text with a blank
    line = F.array_join(texts, " ", " ")
    parts = F.split(F.lower(line), " ", -1)
    plain = (F.octet_length(line) == F.char_length(line)) & (F.size(parts) == F.size(texts))
    return F.when(plain, parts).otherwise(F.transform(texts, normalize_word))


def page_text(lines: DataFrame) -> DataFrame:
    """Text of each page, one visual line per row of text."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy(*PAGE).agg(F.array_join(ordered["text"], "\n").alias("text"))


def words_between(words: Column, x0: Column, x1: Column) -> Column:
    """Words of a line whose horizontal centre lies in ``[x0, x1)``."""
    return F.filter(words, lambda w: (w["cx"] >= x0) & (w["cx"] < x1))


def cell_words(words: Column, cols: Column, ordinal: int) -> Column:
    """Words of a line that fall in the column with this ordinal."""
    col = F.get(cols, F.lit(ordinal))
    return words_between(words, col["x0"], col["x1"])


def cell_text(words: Column, cols: Column, ordinal: int) -> Column:
    return F.array_join(cell_words(words, cols, ordinal)["text"], " ")


def join_column_ranges(words: DataFrame, cols: DataFrame) -> DataFrame:
    """Words with the ``ord`` of their column; ``cols(doc_id, page, ord, x0, x1)``.

    The page key carries the join and the range is a residual on it, so a word
    meets only the columns of its own page.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    ranges = cols.select(*PAGE, "ord", F.col("x0").alias("_from"), F.col("x1").alias("_to"))
    return (
        words.join(ranges, list(PAGE))
        .where((centre >= F.col("_from")) & (centre < F.col("_to")))
        .drop("_from", "_to")
    )


def cell_texts(words: Column, cols: Column) -> Column:
    """Texts of all columns of a line, by ordinal."""
    return F.transform(
        cols,
        lambda c: F.trim(F.array_join(words_between(words, c["x0"], c["x1"])["text"], " ")),
    )


def group_cells(words: Column) -> Column:
    """Cells of a line: cut where the gap exceeds 0.8 mean word width, at least 8 points.

    Returns an array of ``struct(label, centre)``, left to right.
    """
    widths = F.filter(F.transform(words, lambda w: w["x1"] - w["x0"]), lambda d: d > 0)
    mean = let(
        widths,
        lambda d: F.when(
            F.size(d) > 0, F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
        ).otherwise(F.lit(10.0)),
    )

    def starts(limit: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(words) - 1),
            lambda i: (i == 0) | (F.get(words, i)["x0"] - F.get(words, i - 1)["x1"] > limit),
        )

    def cells(at: Column) -> Column:
        return F.transform(
            at,
            lambda start, k: let(
                F.slice(words, start + 1, F.coalesce(F.get(at, k + 1), F.size(words)) - start),
                lambda part: F.struct(
                    F.trim(F.array_join(part["text"], " ")).alias("label"),
                    (
                        (F.get(part, F.lit(0))["x0"] + F.get(part, F.size(part) - 1)["x1"]) / 2
                    ).alias("centre"),
                ),
            ),
        )

    limit = F.greatest(mean * 0.8, F.lit(8.0))
    return F.when(F.size(words) > 0, let(let(limit, starts), cells))


def label_value_pairs(texts: Column, is_value) -> Column:
    """Pairs ``label: value`` of a line as ``array<struct<label, value>>``.

    A label runs up to a token ending in ``:``; the next token is its value when
    ``is_value`` accepts it, else the value is empty. A line in which no pair has
    a value gives no pairs; tokens after the last pair are not a label.
    """

    def value_after(end: Column) -> Column:
        following = F.get(texts, end + 1)
        return F.when(is_value(following), following).otherwise(F.lit(""))

    def pair(end: Column, k: Column, ends: Column) -> Column:
        # the label starts after the previous pair, its value included
        before = F.when(k > 0, F.get(ends, k - 1))
        taken = let(before, lambda b: F.when(value_after(b) != "", F.lit(2)).otherwise(F.lit(1)))
        start = F.when(k > 0, F.get(ends, k - 1) + taken).otherwise(F.lit(0))
        words = let(start, lambda s: F.slice(texts, s + 1, F.greatest(end - s + 1, F.lit(0))))
        label = F.trim(F.regexp_replace(F.array_join(words, " "), ":$", ""))
        return F.struct(label.alias("label"), value_after(end).alias("value"))

    none = F.array().cast("array<struct<label:string,value:string>>")
    pairs = let(
        places(texts, lambda t: F.endswith(t, F.lit(":"))),
        lambda ends: F.filter(
            F.transform(ends, lambda end, k: pair(end, k, ends)), lambda p: p["label"] != ""
        ),
    )
    some = F.exists(texts, lambda t: F.endswith(t, F.lit(":"))) & F.exists(texts, is_value)
    valued = let(
        pairs, lambda p: F.when(F.exists(p, lambda x: x["value"] != ""), p).otherwise(none)
    )
    return F.when(some, valued).otherwise(none)

"""Fingerprints of transcribed texts that tell which paragraphs two versions do not share.

A fingerprint is an invertible Bloom lookup table over the digests of a text's different paragraphs (lines that
are not blank). It has three rows of ``width`` cells; a digest goes to one cell of each row, which holds how many
digests it has, the XOR of them and the XOR of their checks. Cell by cell, the difference of two tables is a table
of the digests that only one version has; a cell holding one digest gives it away, taking it out makes further
cells single, and so all differing digests are peeled off.

The small table of the fingerprint holds only a few differences. Where peeling it stops early, larger tables
follow: the digests are cut by their leading bits into sub-tables for about ``PER_TABLE`` digests, and a sub-table
that cannot be peeled is made again, four and sixteen times as wide with other hashes. What even those leave
(two digests in the same three cells of every table) is compared digest by digest.

DataFrame functions only: no Python touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.bind import let

#: Cells in each of the three rows of a fingerprint.
WIDTH = 8
#: Digests of both versions for which a sub-table is made.
PER_TABLE = 8
#: Texts of neighbouring numbers that are put in order together.
RUN = 1024
ROWS = 3
#: Rounds of peeling; each takes out all digests that stand alone.
ROUNDS = 10


def paragraph_digests(text: Column) -> Column:
    """Sorted digests of the different paragraphs that are not blank."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")
    return F.array_sort(F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line))))


def _changed(cells: Column, digest: Column, by: Column, width: int, salt: int) -> Column:
    """``cells`` after putting a digest in (``by`` = 1) or taking it out (-1)."""

    def put(cells: Column, place: Column) -> Column:
        old = F.get(cells, place)
        new = F.struct(
            (old["n"] + by).alias("n"),
            old["digest"].bitwiseXOR(digest).alias("digest"),
            old["check"].bitwiseXOR(F.hash(digest)).alias("check"),
        )
        return F.concat(F.slice(cells, F.lit(1), place), F.array(new), F.slice(cells, place + 2, F.lit(ROWS * width)))

    def in_row(cells: Column, row: int) -> Column:
        place = F.pmod(F.xxhash64(digest, F.lit(salt + row)), F.lit(width)).cast("int") + row * width
        return let(cells, lambda cells: let(place, lambda place: put(cells, place)))

    for row in range(ROWS):
        cells = in_row(cells, row)
    return cells


def table_of(digests: Column, width: int = WIDTH, salt: int = 0) -> Column:
    """array<struct<n, digest, check>>: the lookup table of an array of digests."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("digest"), F.lit(0).alias("check"))
    return F.aggregate(
        digests, F.array_repeat(empty, ROWS * width), lambda cells, digest: _changed(cells, digest, F.lit(1), width, salt)
    )


def subtracted(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct(
        (a["n"] - b["n"]).alias("n"),
        a["digest"].bitwiseXOR(b["digest"]).alias("digest"),
        a["check"].bitwiseXOR(b["check"]).alias("check"),
    ))


def peeled(cells: Column, width: int = WIDTH, salt: int = 0) -> Column:
    """array<struct<digest, n>> of all digests in a difference (n: 1 left only, -1 right only); NULL if peeling stops early."""
    none = F.array().cast("array<struct<digest: bigint, n: int>>")

    def round_of(state: Column, _: Column) -> Column:
        single = F.filter(
            state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.hash(c["digest"]) == c["check"])
        )
        found = F.array_distinct(F.transform(single, lambda c: F.struct(c["digest"].alias("digest"), c["n"].alias("n"))))

        def taken(found: Column) -> Column:
            rest = F.aggregate(
                found, state["cells"], lambda cells, x: _changed(cells, x["digest"], -x["n"], width, salt)
            )
            return F.when(
                F.size(found) == 0, F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("more"))
            ).otherwise(F.struct(rest.alias("cells"), F.concat(state["found"], found).alias("found"), F.lit(True).alias("more")))

        return F.when(state["more"], let(found, taken)).otherwise(state)

    start = F.struct(cells.alias("cells"), none.alias("found"), F.lit(True).alias("more"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, round_of, lambda end: F.when(
        ~F.exists(end["cells"], lambda c: (c["n"] != 0) | (c["digest"] != 0) | (c["check"] != 0)), end["found"]
    ))


def _sub_tables(left: Column, right: Column) -> Column:
    """array<struct<left, right>>: both sorted arrays cut by the leading bits of the digests."""
    bits = F.greatest(F.lit(1), F.ceil(F.log2((F.size(left) + F.size(right)) / F.lit(PER_TABLE))).cast("int"))

    def cut(bits: Column) -> Column:
        half = F.call_function("shiftleft", F.lit(1), bits - 1)

        def border(digests: Column, table: Column) -> Column:
            """How many digests stand before the sub-table: binary search."""
            steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(digests) + F.lit(1.0))).cast("int"))

            def step(s: Column, _: Column) -> Column:
                def at(middle: Column) -> Column:
                    leading = F.call_function("shiftright", F.get(digests, middle), F.lit(64) - bits)
                    return F.when(
                        leading < table, F.struct((middle + 1).alias("low"), s["high"].alias("high"))
                    ).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

                return let(F.floor((s["low"] + s["high"]) / 2).cast("int"), at)

            start = F.struct(F.lit(0).alias("low"), F.size(digests).alias("high"))
            return F.aggregate(steps, start, step, lambda s: s["low"])

        def borders(digests: Column) -> Column:
            return F.transform(F.sequence(-half, half), lambda table: border(digests, table))

        def both(lefts: Column) -> Column:
            def tables(rights: Column) -> Column:
                def one(i: Column) -> Column:
                    def part(digests: Column, at: Column) -> Column:
                        return F.slice(digests, F.get(at, i) + 1, F.get(at, i + 1) - F.get(at, i))

                    return F.struct(part(left, lefts).alias("left"), part(right, rights).alias("right"))

                return F.transform(F.sequence(F.lit(0), 2 * half - 1), one)

            return let(borders(right), tables)

        return let(borders(left), both)

    return let(bits, cut)


def _count_by_table(left: Column, right: Column, width: int, salt: int) -> Column:
    """How many digests differ, from tables of this width; NULL if peeling stops early."""
    return F.array_size(peeled(subtracted(table_of(left, width, salt), table_of(right, width, salt)), width, salt))


def differing(left: Column, right: Column, left_table: Column, right_table: Column) -> Column:
    """How many paragraph digests only one version has.

    ``left`` and ``right`` are ``paragraph_digests``, the tables ``table_of`` them. A table that cannot be peeled gives NULL, and
    ``coalesce`` goes on to the next, larger one.
    """

    def count(pair: Column) -> Column:
        a, b = pair["left"], pair["right"]
        exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
        return F.coalesce(
            _count_by_table(a, b, WIDTH, ROWS), _count_by_table(a, b, 4 * WIDTH, 2 * ROWS),
            _count_by_table(a, b, 16 * WIDTH, 3 * ROWS), exact,
        )

    larger = F.aggregate(_sub_tables(left, right), F.lit(0), lambda total, pair: total + count(pair))
    return F.coalesce(F.array_size(peeled(subtracted(left_table, right_table))), larger)


def likeness(left: Column, right: Column, left_table: Column, right_table: Column) -> Column:
    """Shared paragraphs to all different paragraphs of two versions, 0 to 1; 1 for two versions without any."""
    total = F.size(left) + F.size(right)
    return let(differing(left, right, left_table, right_table), lambda d: F.when(total == 0, 1.0).otherwise((total - d) / (total + d)))


def printed(table: Column) -> Column:
    """A lookup table as text: count, digests and check of each cell in hexadecimal digits."""
    return F.array_join(F.transform(table, lambda c: F.concat(
        F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["digest"]), 16, "0"),
        F.lpad(F.hex(c["check"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"),
    )), "")


def fingerprint_versions(versions: DataFrame, others: list[str]) -> DataFrame:
    """Fingerprints of a transcribed text and of other versions of it, and how alike they are.

    ``versions`` has ``text`` and the columns named in ``others`` (a corrected text, the next upload). Added are
    ``fingerprint``, and for each other ``<name>_fingerprint`` and ``<name>_likeness``; old columns of these names
    give way, all others stay.

    The fingerprint depends on the set of paragraphs alone: texts that are equal, or differ in the order, blank
    lines or repetition of paragraphs, have the same. NULL is the empty text; a text without paragraphs has a table of
    zeros. Rows are independent, so repeated rows have equal results; an empty table gives an empty one.
    """
    names = ["text", *others]
    taken = {c.lower() for c in versions.columns}
    mark = "_"
    while any(f"{mark}{kind}{i}" in taken for kind in "dt" for i in range(len(names))):
        mark += "_"
    digests = {f"{mark}d{i}": paragraph_digests(F.coalesce(F.col(name), F.lit(""))) for i, name in enumerate(names)}
    tables = {f"{mark}t{i}": table_of(F.col(f"{mark}d{i}")) for i in range(len(names))}
    out = {"fingerprint": printed(F.col(f"{mark}t0"))}
    for i, name in enumerate(others, 1):
        out[f"{name}_fingerprint"] = printed(F.col(f"{mark}t{i}"))
        out[f"{name}_likeness"] = likeness(*(F.col(f"{mark}{kind}{j}") for kind in "dt" for j in (0, i)))
    return versions.withColumns(digests).withColumns(tables).withColumns(out).drop(*digests, *tables)


def with_following(texts: DataFrame, out: str = "following") -> DataFrame:
    """``texts`` (whole ``doc_id``, ``text``) with the text that comes next by ``doc_id``; the first comes after the last.

    NULL ids come first, rows of one id in the order of a hash of their texts. Runs of ``RUN`` neighbouring ids are
    put in order on their own; only their numbers, one in ``RUN`` ids, are ordered as a whole.
    """
    run, place, last, head = "_run", "_place", "_last", "_head"
    cut = texts.select("doc_id", "text").withColumn(
        run, F.coalesce(F.floor(F.col("doc_id") / RUN), F.lit(-(1 << 62))).cast("long")
    )
    inside = Window.partitionBy(run).orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    placed = cut.withColumns({
        place: F.row_number().over(inside), last: F.lead(F.lit(False), 1, True).over(inside), out: F.lead("text").over(inside),
    })
    heads = placed.filter(F.col(place) == 1).select(F.col(run).alias(head), F.col("text").alias("_text"))
    runs = cut.groupBy(run).agg(F.lit(1))
    whole = Window.orderBy(run)
    following = runs.select(run, F.lead(run).over(whole).alias(head), F.min(run).over(Window.partitionBy(F.lit(0))).alias("_least"))
    following = following.select(run, F.coalesce(head, "_least").alias(head))
    next_heads = following.join(heads, head).select(run, "_text")
    joined = placed.join(next_heads, run, "left")
    return joined.select("doc_id", "text", F.when(F.col(last), F.col("_text")).otherwise(F.col(out)).alias(out))

"""Runs of lines that many transcribed texts repeat: cut into content-defined chunks, compared, removed.

Printed forms repeat whole runs of lines. Line numbers say nothing about them, so chunk borders come from the
lines: each line is hashed, a hash rolls over ``window`` line hashes, and a line whose rolling hash is divisible
by ``divisor`` ends a chunk. A line of ``min_words`` words or more is a printed paragraph and a chunk of its own.
Lines put before a run move its borders in the first ``window`` lines at most.

Chunks of two or more lines, or of ``min_words`` words, are looked for in all texts. The first text (smallest
``doc_id``, then first line) keeps a repeated chunk, all later ones lose it. Chunks are found by digest; one is
removed only if all chunks of its digest are equal byte by byte.

Such chunks leave the short lines at and between their borders. ``drop_repeated_runs`` leaves none: after chunks of the
lines that are not blank it looks for every two neighbouring lines outside the chunks that go, wherever they stand, so a run
has the same pairs in all texts and no borders of its own.

DataFrame functions only: no Python touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.bind import let
from inkgrid.llm.common import free_name, kept

LINE = "\n"


def chunk_spans(hashes: Column, long_lines: Column, window: int, divisor: int) -> Column:
    """array<struct<first, n>>: first line (from 0) and lines of each chunk."""

    def ends_chunk(i: Column) -> Column:
        rolling = F.xxhash64(F.slice(hashes, F.greatest(i - (window - 2), F.lit(1)), F.least(i + 1, F.lit(window))))
        return (
            (i == F.size(hashes) - 1)
            | F.get(long_lines, i)
            | F.get(long_lines, i + 1)
            | (F.pmod(rolling, F.lit(divisor)) == 0)
        )

    ends = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), ends_chunk)

    def spans(ends: Column) -> Column:
        def span(end: Column, i: Column) -> Column:
            first = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1) + 1)
            return F.struct(first.alias("first"), (end - first + 1).alias("n"))

        return F.transform(ends, span)

    return let(ends, spans)


def chunks_of(text: Column, window: int, divisor: int, min_words: int, with_text: bool) -> Column:
    """array<struct<first, n, digest[, chunk]>> of the chunks long enough to count."""

    def of_lines(lines: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            def of_long(long_lines: Column) -> Column:
                def described(span: Column) -> Column:
                    fields = [span["first"].alias("first"), span["n"].alias("n")]
                    fields.append(F.xxhash64(F.slice(hashes, span["first"] + 1, span["n"])).alias("digest"))
                    if with_text:
                        chunk = F.array_join(F.slice(lines, span["first"] + 1, span["n"]), LINE)
                        fields.append(chunk.alias("chunk"))
                    return F.struct(*fields)

                spans = chunk_spans(hashes, long_lines, window, divisor)
                counting = F.filter(spans, lambda s: (s["n"] > 1) | F.get(long_lines, s["first"]))
                return F.transform(counting, described)

            spaces = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= min_words - 1)
            return let(spaces, of_long)

        return let(F.transform(lines, lambda x: F.xxhash64(x)), of_hashes)

    return let(F.split(text, LINE, -1), of_lines)


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the lines of ``spans`` (sorted, apart from each other)."""

    def gaps(lines: Column) -> Column:
        def gap(i: Column) -> Column:
            before, after = F.get(spans, i - 1), F.get(spans, i)
            first = F.coalesce(before["first"] + before["n"], F.lit(0))
            return F.slice(lines, first + 1, F.coalesce(after["first"], F.size(lines)) - first)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), gap))

    return F.array_join(let(F.split(text, LINE, -1), gaps), LINE)


def drop_repeated_chunks(
    texts: DataFrame, window: int = 2, divisor: int = 2, min_words: int = 30
) -> DataFrame:
    """``texts`` with every repeated chunk of lines in one place only.

    ``texts`` has ``doc_id`` and ``text``, further columns stay as they are. ``removed_lines`` (int, an old column
    of this name gives way) counts what went. Lines that stay keep their order; a text may become empty.

    NULL texts stay NULL with 0 removed, empty ones empty. Rows with equal ``doc_id`` and ``text`` are one text:
    both keep what the text keeps. NULL ids come before others. An empty table stays empty.
    """
    key = [free_name(texts, "key_id"), free_name(texts, "key_text"), free_name(texts, "spans")]
    own = texts.filter("text is not null").select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"), "text"
    )

    def exploded(with_text: bool) -> DataFrame:
        found = chunks_of(F.col("text"), window, divisor, min_words, with_text)
        return own.select("id", "print", F.explode(found).alias("c")).select("id", "print", "c.*")

    placed = kept(exploded(False))
    place = F.struct("id", "print", "first")
    firsts = placed.groupBy("digest").agg(F.count("*").alias("copies"), F.min(place).alias("keeper")).filter("copies > 1")
    # equal bytes under each digest; the texts themselves are the grouping key
    equal = exploded(True).groupBy("digest", "chunk").agg(F.count("*").alias("copies"))
    equal = equal.groupBy("digest").agg(F.count("*").alias("different")).filter("different = 1")
    repeated = firsts.join(equal, "digest").select("digest", "keeper")
    surplus = placed.join(repeated, "digest").filter(~place.eqNullSafe(F.col("keeper")))
    spans = surplus.groupBy(F.col("id").alias(key[0]), F.col("print").alias(key[1])).agg(
        F.array_sort(F.collect_set(F.struct("first", "n"))).alias(key[2])
    )
    joined = texts.join(
        spans, texts["doc_id"].eqNullSafe(spans[key[0]]) & (F.xxhash64(texts["text"]) == spans[key[1]]), "left"
    )
    return _cleaned(texts, joined, key[2])


def hashed_lines(text: Column, min_words: int) -> Column:
    """struct<told, hashes, long>: numbers (from 0) of the lines that are not blank, their hashes, whether each is long."""

    def of_lines(lines: Column) -> Column:
        def is_long(i: Column) -> Column:
            line = F.get(lines, i)
            return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= min_words - 1

        def of_told(told: Column) -> Column:
            hashes = F.transform(told, lambda i: F.xxhash64(F.get(lines, i)))
            return F.struct(told.alias("told"), hashes.alias("hashes"), F.transform(told, is_long).alias("long"))

        return let(told_lines(lines), of_told)

    return let(F.split(text, LINE, -1), of_lines)


def line_chunks(told: Column, hashes: Column, long_lines: Column, window: int, divisor: int) -> Column:
    """array<struct<first, last, held>>: content-defined chunks long enough to count, and the hashes of their lines."""

    def described(span: Column) -> Column:
        return F.struct(
            F.get(told, span["first"]).alias("first"), F.get(told, span["first"] + span["n"] - 1).alias("last"),
            F.slice(hashes, span["first"] + 1, span["n"]).alias("held"),
        )

    spans = chunk_spans(hashes, long_lines, window, divisor)
    counting = F.filter(spans, lambda s: (s["n"] > 1) | F.get(long_lines, s["first"]))
    return F.when(F.size(hashes) > 0, F.transform(counting, described))


def units_of(told: Column, hashes: Column, long_lines: Column) -> Column:
    """array<struct<first, last, a, b>>: lines (from 0) and hashes of neighbouring lines; ``b`` is NULL for a long line alone."""

    def pair(i: Column, k: Column) -> Column:
        return F.struct(
            i.alias("first"), F.get(told, k + 1).alias("last"), F.get(hashes, k).alias("a"), F.get(hashes, k + 1).alias("b")
        )

    def alone(i: Column, k: Column) -> Column:
        unit = F.struct(i.alias("first"), i.alias("last"), F.get(hashes, k).alias("a"), F.lit(None).cast("long").alias("b"))
        return F.when(F.get(long_lines, k), unit)

    pairs = F.filter(F.transform(told, pair), lambda u: u["last"].isNotNull())
    return F.concat(pairs, F.array_compact(F.transform(told, alone)))


def surplus_chunks(hashed: DataFrame, unlike: DataFrame, window: int, divisor: int) -> DataFrame:
    """(id, print, first, last): chunks that an earlier place holds too, line by line.

    ``hashed`` has ``id``, ``print`` and what ``hashed_lines`` tells; ``unlike`` the hashes that different lines share.
    """
    found = line_chunks(F.col("told"), F.col("hashes"), F.col("long"), window, divisor)
    placed = hashed.select("id", "print", F.explode(found).alias("c")).select("id", "print", "c.*")
    place = F.struct("id", "print", "first", "last")
    firsts = placed.groupBy("held").agg(F.count("*").alias("copies"), F.min(place).alias("keeper")).filter("copies > 1")
    firsts = firsts.join(unlike, F.array_contains("held", F.col("hash")), "left_anti")
    surplus = placed.join(firsts, "held").filter(~place.eqNullSafe(F.col("keeper")))
    return surplus.select("id", "print", "first", "last")


def told_lines(lines: Column) -> Column:
    """Numbers (from 0) of the lines that are not blank."""
    return F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.btrim(F.get(lines, i), F.lit(" \t\r\f\v")) != ""
    )


def spans_of(numbers: Column) -> Column:
    """array<struct<first, n>>: the spans that sorted line numbers form."""
    firsts = F.filter(numbers, lambda x, k: F.coalesce(F.get(numbers, k - 1) != x - 1, F.lit(True)))
    lasts = F.filter(numbers, lambda x, k: F.coalesce(F.get(numbers, k + 1) != x + 1, F.lit(True)))
    return F.zip_with(firsts, lasts, lambda a, z: F.struct(a.alias("first"), (z - a + 1).alias("n")))


def drop_repeated_runs(texts: DataFrame, min_words: int = 30, window: int = 2, divisor: int = 2) -> DataFrame:
    """``texts`` with every repeated run of two or more lines, and every repeated long line, in one place only.

    Content-defined chunks come first: of equal ones the first place stays, at later places their lines go. An exact check
    of what is left follows: every two neighbouring lines, and every line of ``min_words`` words, stay where they stand first
    (smallest ``doc_id``, then first line); at all later places these lines go. The first place of two lines never lies in a
    chunk that went, so ``window`` and ``divisor`` decide what the chunks find, not the result. Each line that goes stays in
    an earlier place. Lines are equal byte by byte. Blank lines neither form nor part a run; those within a run go with it.

    ``texts`` has ``doc_id`` and ``text``, further columns stay as they are. ``removed_lines`` (int, an old column
    of this name gives way) counts what went. Lines that stay keep their order; a text may become empty.

    NULL texts stay NULL with 0 removed, empty ones empty. Rows with equal ``doc_id`` and ``text`` are one text:
    both keep what the text keeps. NULL ids come before others. An empty table stays empty.
    """
    key = [free_name(texts, "key_id"), free_name(texts, "key_text"), free_name(texts, "spans")]
    own = texts.filter("text is not null").select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"), "text"
    )
    # lines of equal hash and different bytes, of which there are hardly any; the lines themselves are the grouping key
    lines = own.select(F.explode(F.split("text", LINE, -1)).alias("line")).groupBy(F.xxhash64("line").alias("hash"), "line").agg(F.count("*"))
    unlike = kept(lines.groupBy("hash").agg(F.count("*").alias("different")).filter("different > 1").select("hash"))
    # made from the texts where they are needed: read again they cost less than written
    hashed = own.select("id", "print", hashed_lines(F.col("text"), min_words).alias("h")).select("id", "print", "h.*")
    gone = surplus_chunks(hashed, unlike, window, divisor).groupBy(F.col("id").alias("gone_id"), F.col("print").alias("gone_print")).agg(
        F.collect_set(F.struct("first", "last")).alias("chunks")
    )
    met = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("print") == F.col("gone_print"))
    left = kept(hashed.join(gone, met, "left").drop("gone_id", "gone_print"))
    units = F.filter(
        units_of(F.col("told"), F.col("hashes"), F.col("long")),
        lambda u: ~F.coalesce(F.exists("chunks", lambda c: (u["first"] >= c["first"]) & (u["last"] <= c["last"])), F.lit(False)),
    )
    placed = left.select("id", "print", F.explode(units).alias("u")).select("id", "print", "u.*")
    place = F.struct("id", "print", "first", "last")
    firsts = placed.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min(place).alias("keeper")).filter("copies > 1")
    repeated = firsts.join(unlike, F.col("a") == F.col("hash"), "left_anti")
    repeated = kept(repeated.join(unlike, F.col("b") == F.col("hash"), "left_anti").select("a", "b", "keeper"))
    first, second = repeated.filter("b is not null"), repeated.filter("b is null").drop("b")
    surplus = placed.filter("b is not null").join(first, ["a", "b"]).select("id", "print", "first", "last", "keeper").unionByName(
        placed.filter("b is null").join(second, "a").select("id", "print", "first", "last", "keeper")
    )
    # of three equal lines the second pair begins in the first one, which stays
    same = F.col("keeper.id").eqNullSafe(F.col("id")) & (F.col("keeper.print") == F.col("print"))
    start = F.when(same, F.greatest("first", F.col("keeper.last") + 1)).otherwise(F.col("first"))
    surplus = surplus.filter(~place.eqNullSafe(F.col("keeper"))).select("id", "print", F.explode(F.sequence(start, "last")).alias("line"))
    of_chunks = left.select("id", "print", F.explode("chunks").alias("c"))
    of_chunks = of_chunks.select("id", "print", F.explode(F.sequence(F.col("c.first"), F.col("c.last"))).alias("line"))
    spans = surplus.unionByName(of_chunks).groupBy(F.col("id").alias(key[0]), F.col("print").alias(key[1])).agg(
        F.array_sort(F.collect_set("line")).alias(key[2])
    ).withColumn(key[2], spans_of(F.col(key[2])))
    joined = texts.join(
        spans, texts["doc_id"].eqNullSafe(spans[key[0]]) & (F.xxhash64(texts["text"]) == spans[key[1]]), "left"
    )
    return _cleaned(texts, joined, key[2])


def _cleaned(texts: DataFrame, joined: DataFrame, spans: str) -> DataFrame:
    """The columns of ``texts`` without the lines of the column ``spans``, and ``removed_lines``."""
    some = F.col(spans).isNotNull()
    removed = F.aggregate(spans, F.lit(0), lambda total, span: total + span["n"])
    others = [texts[c] for c in texts.columns if c.lower() not in ("text", "removed_lines")]
    cleaned = F.when(some, without_spans(texts["text"], F.col(spans))).otherwise(texts["text"])
    out = joined.select(*others, cleaned.alias("text"), F.coalesce(removed, F.lit(0)).alias("removed_lines"))
    order = [c for c in texts.columns if c.lower() != "removed_lines"]
    return out.select(*order, "removed_lines")

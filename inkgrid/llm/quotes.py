"""Replies that quote: linking quotations in messages to the messages they come from.

The library's own records hold no messages. So this operator is general: it takes any table of ``conv_id``, ``turn``,
``role`` and ``text``.

Lines led by ``>`` are quoted, as deep as there are marks. Neighbouring quoted lines of one level are a passage; a blank
line ends it. What was quoted is normalised (lower case, letters and digits only, single spaces) and hashed, first line
by line, as are the lines each message says itself: a quoted line comes from the latest earlier message of the
conversation that says it. A passage with a line that nobody says (wrapped anew, or cut out of a longer line) is then
hashed as a whole: its first words are looked up among the word-aligned windows of earlier messages, and where they
stand, the window as long as the passage is compared with it word by word. A passage found so takes all its lines along.
Passages under ``WORDS`` words are linked by whole lines only, as a few words stand in many messages.

The message most lines of the first level come from is the one replied to. Threads follow these replies back to a message
that quotes nothing known.

DataFrame functions only. A line or window that a conversation repeats very often is scanned in order, never paired
with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.bind import let
from inkgrid.llm.common import kept

#: Words of the windows that passages are looked up by.
WORDS = 5

MARKED = r"^((?:[ \t]{0,3}>)+)"


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKED, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normalised(line: Column) -> Column:
    """The words of a line without its marks."""
    said = F.regexp_replace(line, MARKED, "")
    return F.trim(F.regexp_replace(F.lower(said), r"[^\p{L}\p{N}]+", " "))


def without_quotes(text: Column) -> Column:
    """The lines that are not quoted; runs of blank lines left by quotations become one, ends are trimmed."""
    said = F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(MARKED)), "\n")
    return F.regexp_replace(F.regexp_replace(said, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"), r"^\s+|\s+$", "")


def told(text: Column) -> Column:
    """array<struct<level, said>>: the lines of a message."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.struct(quote_level(line).alias("level"), normalised(line).alias("said")))


def passages(text: Column) -> Column:
    """array<struct<level, lines>>: runs of neighbouring lines quoted at one level, none of them blank."""

    def of_lines(lines: Column) -> Column:
        def continues(i: Column, step: int) -> Column:
            here, there = F.get(lines, i), F.get(lines, i + step)
            return F.coalesce((there["level"] == here["level"]) & (there["said"] != ""), F.lit(False))

        def ends(step: int) -> Column:
            quoted = lambda i: (F.get(lines, i)["level"] > 0) & (F.get(lines, i)["said"] != "")
            return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: quoted(i) & ~continues(i, step))

        def passage(first: Column, last: Column) -> Column:
            said = F.slice(lines, first + 1, last - first + 1)["said"]
            return F.struct(F.get(lines, first)["level"].alias("level"), said.alias("lines"))

        return F.zip_with(ends(-1), ends(1), passage)

    return let(told(text), of_lines)


def latest_before(asked: DataFrame, said: DataFrame) -> DataFrame:
    """``asked`` (conv_id, turn, text and more) with ``origin``: the latest earlier turn of the conversation that holds
    the text among ``said`` (conv_id, turn, text).

    Equal texts are scanned in order of turns. At one turn what is asked comes first, so that no message quotes itself.
    """
    more = [c for c in asked.columns if c not in ("conv_id", "turn", "text")]
    both = asked.withColumn("own", F.lit(False)).unionByName(said.distinct().withColumn("own", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "hash", "text").orderBy("turn", "own").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.last(F.when(F.col("own"), F.col("turn")), ignorenulls=True).over(before)
    found = both.withColumn("hash", F.xxhash64("text")).withColumn("origin", origin)
    return found.filter(~F.col("own")).select("conv_id", "turn", *more, "origin")


def windows_of(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, turn, text): the windows of what messages say that begin and are as long as an asked passage.

    ``asked`` has ``conv_id`` and ``text``. Positions travel without the words around them; only where a window begins
    like a passage is it cut out of its message.
    """
    first = lambda words, at: F.xxhash64(F.array_join(F.slice(words, at + 1, F.lit(WORDS)), " "))
    words = F.split("text", " ")
    wanted = asked.select("conv_id", F.size(words).alias("length"), first(words, F.lit(0)).alias("begins"))
    wanted = wanted.groupBy("conv_id", "begins").agg(F.collect_set("length").alias("lengths"))
    own = F.filter(told(F.col("text")), lambda line: (line["level"] == 0) & (line["said"] != ""))["said"]
    said = messages.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi").select(
        "conv_id", "turn", F.xxhash64("text").alias("print"), F.split(F.array_join(own, " "), " ").alias("words")
    ).filter(F.size("words") >= WORDS)
    starts = F.transform(F.sequence(F.lit(0), F.size("words") - WORDS), lambda at: F.struct(at.alias("at"), first(F.col("words"), at).alias("begins")))
    places = said.select("conv_id", "turn", "print", F.explode(starts).alias("p")).select("conv_id", "turn", "print", "p.*")
    hits = places.join(wanted, ["conv_id", "begins"]).select("conv_id", "turn", "print", "at", F.explode("lengths").alias("length"))
    cuts = hits.groupBy("conv_id", "turn", "print").agg(F.collect_set(F.struct("at", "length")).alias("cuts"))
    texts = F.transform(
        F.filter("cuts", lambda c: c["at"] + c["length"] <= F.size("words")),
        lambda c: F.array_join(F.slice("words", c["at"] + 1, c["length"]), " "),
    )
    return said.join(cuts, ["conv_id", "turn", "print"]).select("conv_id", "turn", F.explode(texts).alias("text"))


def quotation_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, origin, n): how many lines quoted at a level come from which earlier turn (NULL: none known)."""
    quoted = messages.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p")).select("conv_id", "turn", "p.*")
    quoted = quoted.withColumn("passage", F.sha2(F.array_join("lines", "\n"), 256))
    whole = kept(quoted.groupBy("conv_id", "turn", "level", "passage").agg(F.first("lines").alias("lines"), F.count("*").alias("n")))
    # only conversations that quote are compared
    quoting = messages.join(whole.select("conv_id").distinct(), "conv_id", "left_semi")
    lines = whole.select("conv_id", "turn", "level", "passage", "n", F.explode("lines").alias("text"))
    own = quoting.select("conv_id", "turn", F.explode(told(F.col("text"))).alias("t")).filter("t.level = 0 and t.said <> ''")
    found = kept(latest_before(lines, own.select("conv_id", "turn", F.col("t.said").alias("text"))))
    key = ["conv_id", "turn", "level", "passage"]
    lost = whole.join(found.filter("origin is null").select(*key).distinct(), key, "left_semi")
    asked = lost.select(*key, F.array_join("lines", " ").alias("text")).filter(F.size(F.split("text", " ")) >= WORDS)
    cut = latest_before(asked, windows_of(messages, asked)).filter("origin is not null").withColumnRenamed("origin", "as_passage")
    both = found.join(cut, key, "left").withColumn("origin", F.coalesce("as_passage", "origin"))
    return both.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))


def threads(replies: DataFrame) -> DataFrame:
    """``replies`` (conv_id, turn, reply_to) with ``thread``: the first turn that its replies lead back to.

    Each round doubles how far back a turn looks, so a chain of a thousand replies takes ten.
    """
    state = replies.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        state = kept(state)
        back = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        looked = state.join(back, ["conv_id", "thread"], "left")
        if not looked.filter("further is not null").head(1):
            return replies.join(state, ["conv_id", "turn"])
        state = looked.select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id``, ``turn``, ``role``, ``text`` without quotations, ``reply_to`` (the turn quoted,
    NULL if none), ``thread`` (the turn its thread starts at, its own if it quotes nothing known), ``quoted_lines`` and
    ``quote_levels``. Ordered by ``conv_id, thread, turn`` the rows are the conversations, each reply behind what it quotes.

    Of messages quoted equally often the latest counts. NULL texts stay NULL and quote nothing; blank lines are never
    compared. NULL ``conv_id`` or ``turn`` are not linked. Rows repeating a conversation and turn are one message for
    linking and stay as they are. An empty table gives an empty one; further columns are not read.
    """
    links = kept(quotation_links(messages.select("conv_id", "turn", "text").dropna()))
    totals = links.groupBy("conv_id", "turn").agg(
        F.sum("n").alias("quoted_lines"),
        F.max("level").alias("quote_levels"),
        F.max_by("origin", F.when((F.col("level") == 1) & F.col("origin").isNotNull(), F.struct("n", "origin"))).alias("reply_to"),
    )
    linked = threads(totals.filter("reply_to is not null").select("conv_id", "turn", "reply_to"))
    known = totals.drop("reply_to").join(linked, ["conv_id", "turn"], "left")
    out = messages.select("conv_id", "turn", "role", without_quotes(F.col("text")).alias("text")).join(
        known, ["conv_id", "turn"], "left"
    )
    return out.select(
        "conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("quoted_lines", F.lit(0)).alias("quoted_lines"), F.coalesce("quote_levels", F.lit(0)).alias("quote_levels"),
    )

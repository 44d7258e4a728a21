"""Accent-free lower-case text, kept inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables decompose by arithmetic: 19 leads, 21 vowels, 28 tails (the first of them none).
_SYLLABLES = (0xAC00, 0xD7A3)
_LEADS, _VOWELS, _TAILS = 0x1100, 0x1161, 0x11A7


@cache
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form is one base character, with it and followed by the marks to drop; and the
    characters whose form is several base characters.

    Built from the Unicode data, so no list is kept by hand. ``translate`` drops
    every source character that has no partner, hence the marks come last.
    """
    source, target, marks, several = [], [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or _SYLLABLES[0] <= point <= _SYLLABLES[1]:
            continue
        char = chr(point)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != char:
            source.append(char)
            target.append(plain)
        elif plain != char:
            several[char] = plain
    return "".join(source + marks), "".join(target), several


def _ranges(chars: list[str]) -> str:
    """A character class of a pattern, runs of neighbours as ranges."""
    points, runs = sorted(map(ord, chars)), []
    for point in points:
        if runs and point == runs[-1][1] + 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


@cache
def _several_class() -> str:
    *_, several = _fold_table()
    return f"[{_ranges([*several, *map(chr, range(_SYLLABLES[0], _SYLLABLES[1] + 1))])}]"


@cache
def _several_lists() -> tuple[str, str]:
    """The characters, and what each stands for, a line each in the same order."""
    *_, several = _fold_table()
    return "".join(several), "\n".join(several.values())


def _spelt_out(col: Column) -> Column:
    """Characters that stand for several (ligatures, fractions, syllables) replaced by these.

    One lambda and no variable of another inside it: only then can a function of Python that takes the result be told
    apart from its copies when the plan is made.
    """
    chars, plain = _several_lists()
    jamo = [F.lit("".join(map(chr, range(start, start + n)))) for start, n in ((_LEADS, 19), (_VOWELS, 21), (_TAILS, 28))]

    def spell(char: Column) -> Column:
        syllable = F.ascii(char) - _SYLLABLES[0]
        tail = F.when(syllable % 28 == 0, F.lit("")).otherwise(F.substr(jamo[2], syllable % 28 + 1, F.lit(1)))
        parts = F.concat(
            F.substr(jamo[0], F.floor(syllable / 588).cast("int") + 1, F.lit(1)),
            F.substr(jamo[1], F.floor(syllable % 588 / 28).cast("int") + 1, F.lit(1)), tail,
        )
        known = F.get(F.split(F.lit(plain), "\n"), F.position(char, F.lit(chars)) - 1)
        own = F.when(F.ascii(char).between(*_SYLLABLES), parts).otherwise(F.coalesce(known, char))
        # the list is walked for the few characters beyond ASCII only
        return F.when(F.ascii(char) < 0x80, char).otherwise(own)

    return F.array_join(F.transform(F.split(col, ""), spell), "")


def _folded(col: Column) -> Column:
    source, target, _ = _fold_table()
    spelt = F.when(F.rlike(col, F.lit(_several_class())), _spelt_out(col)).otherwise(col)
    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(F.translate(spelt, source, target))


def normalize_text(col: Column) -> Column:
    """Compatibility-decompose, drop accents, trim, lower-case.

    Plain ASCII text, which is most of it, skips the table and the pattern; only text with a character that stands for
    several is taken apart.
    """
    plain = F.octet_length(col) == F.char_length(col)
    folded = F.regexp_replace(_folded(col), r"^\s+|\s+$", "")
    return F.lower(F.when(plain, F.btrim(col, F.lit(" \t\n\x0b\f\r"))).otherwise(folded))


def normalize_word(col: Column) -> Column:
    """Same for a word, which carries no blanks at its ends."""
    return F.lower(F.trim(_folded(col)))


def normalize_name(col: Column) -> Column:
    """Same for a word that is compared with month names: none of them holds a character that stands for several."""
    source, target, _ = _fold_table()
    folded = F.translate(col, source, target)
    return F.lower(F.trim(F.when(F.octet_length(col) == F.char_length(col), col).otherwise(folded)))


def contains_mark(col: Column) -> Column:
    return F.contains(col, F.lit("?"))

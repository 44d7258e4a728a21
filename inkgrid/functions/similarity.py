"""Ratcliff-Obershelp similarity, the one measure Spark has no function for.

``plausible`` is a bound inside the JVM: it never rejects a pair that reaches the
threshold. Only lines that pass it travel to Python, as Arrow batches.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from inkgrid import fixed


@lru_cache(maxsize=100_000)
def ratio(read: str, expected: str) -> float:
    """2M/T of the text read against the text expected."""
    return 1.0 if read == expected else SequenceMatcher(None, read, expected).ratio()


def plausible(word: Column, title: str, threshold: float) -> Column:
    """Upper bound of the ratio reaches ``threshold``: lengths and shared characters."""
    size = len(title)
    shortest = math.ceil(size * threshold / (2 - threshold) - 1e-9)
    longest = math.floor(size * (2 - threshold) / threshold + 1e-9)
    length = F.char_length(word)
    shared = length - F.char_length(F.translate(word, "".join(sorted(set(title))), ""))
    scaled = int(round(threshold * 100))
    return length.between(shortest, longest) & (
        F.least(shared, F.lit(size)) * 200 >= (length + size) * scaled
    )


@arrow_udf(T.DoubleType())
def title_similarity(read: pa.Array, expected: pa.Array) -> pa.Array:
    """Ratio of two columns of normalised text."""
    pairs = zip(read.to_pylist(), expected.to_pylist())
    return pa.array(
        [None if a is None or b is None else ratio(a, b) for a, b in pairs], pa.float64()
    )


_MATCHES = T.ArrayType(
    T.StructType()
    .add("layout", T.IntegerType())
    .add("score", T.DoubleType())
    .add("at", T.ArrayType(T.IntegerType()))
)
_MATCH = pa.list_(
    pa.struct([("layout", pa.int32()), ("score", pa.float64()), ("at", pa.list_(pa.int32()))])
)


def _match(words: list[str], titles: tuple[str, ...], threshold: float):
    """Positions and mean ratio when every title is found in order, else None."""
    found, total = [], 0.0
    for position, word in enumerate(words):
        score = ratio(word, titles[len(found)])
        if score >= threshold:
            found.append(position)
            total += score
            if len(found) == len(titles):
                return found, total / len(titles)
    return None


def title_matcher(titles_by_layout: dict[int, tuple[str, ...]], threshold: float):
    """Arrow function ``(words, layouts) -> matches`` over candidate lines.

    A NULL word list marks a line that is no candidate and costs nothing.
    """

    @arrow_udf(_MATCHES)
    def match_titles(words: pa.Array, layouts: pa.Array) -> pa.Array:
        out = []
        for line, ids in zip(words.to_pylist(), layouts.to_pylist()):
            hits = []
            for layout in ids or () if line is not None else ():
                hit = _match(line, titles_by_layout[layout], threshold)
                if hit:
                    hits.append({"layout": layout, "score": hit[1], "at": hit[0]})
            out.append(hits or None)
        return pa.array(out, _MATCH)

    return match_titles


@lru_cache(maxsize=100_000)
def _months_of(name: str) -> tuple[int, ...]:
    """1..12 of the most similar month names, all of them on ties, in calendar order."""
    if len(name) < 4:
        return ()
    best, winners = fixed.MONTH_THRESHOLD, []
    for k, month in enumerate(fixed.MONTH_NAMES, 1):
        matcher = SequenceMatcher(None, name, month)
        # cheap upper bounds first: most names cannot reach the threshold
        if min(matcher.real_quick_ratio(), matcher.quick_ratio()) >= best:
            score = matcher.ratio()
            if score > best:
                winners = []
            if score >= best:
                best = score
                winners.append(k)
    return tuple(winners)


@arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def month_numbers(names: pa.Array) -> pa.Array:
    """Month numbers each word of a line is most similar to, NULL without any; NULL words are not looked at."""
    return pa.array(
        [
            None if line is None else [None if name is None else _months_of(name) or None for name in line]
            for line in names.to_pylist()
        ],
        pa.list_(pa.list_(pa.int32())),
    )


def plausible_month(name: Column) -> Column:
    """Necessary condition for a month name, without looking at each: length and letters.

    Settles numbers, codes and short words; repeated labels are remembered on
    the Python side.
    """
    letters = "".join(sorted(set("".join(fixed.MONTH_NAMES))))
    sizes = [len(month) for month in fixed.MONTH_NAMES]
    scaled = int(round(fixed.MONTH_THRESHOLD * 100))
    longest = math.floor(max(sizes) * (2 - fixed.MONTH_THRESHOLD) / fixed.MONTH_THRESHOLD + 1e-9)
    length = F.char_length(name)
    shared = length - F.char_length(F.translate(name, letters, ""))
    return length.between(4, longest) & (shared * 200 >= (length + min(sizes)) * scaled)

"""Fill-in-the-middle rearrangement of transcribed texts.

A text is cut into *units* (code points, or the lines of its pages), two cuts are drawn from a hash of the document's id,
and prefix, middle and suffix are written in another order behind marks, so that a model learns to fill gaps.

The place of a cut is found without walking the text: a Fenwick tree over blocks of ``BLOCK`` bytes of its UTF-8 form
holds how many units and code points begin in each; a binary-lifting descent finds the block in which a unit begins, and
the boundary is then looked for in that block only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes in a block.
BLOCK = 1024
#: Units: every code point, or every line with its line feed. A pattern's matches must cover a text without gaps.
CODE_POINTS = None
LINES = r"[^\n]*\n|[^\n]+"


class CutTree:
    """Units and code points of one text, as prefix sums over blocks of its UTF-8 form."""

    def __init__(self, text: str, unit: str | None = CODE_POINTS, block: int = BLOCK) -> None:
        # lone surrogates, which no stored text holds, keep a length of their own
        self.raw = text.encode("utf-8", "surrogatepass")
        self.block = block
        heads = (np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80
        self.unit_heads = heads if unit is CODE_POINTS else self._starts(text, unit, heads)
        self.heads = heads
        n = -(-len(self.raw) // block)
        edges = np.arange(n) * block
        self.units, self.points = (
            self._tree(np.add.reduceat(marks.astype(np.int64), edges) if n else np.zeros(0, np.int64))
            for marks in (self.unit_heads, heads)
        )
        self.n = int(self.unit_heads.sum())

    @staticmethod
    def _starts(text: str, unit: str, heads: np.ndarray) -> np.ndarray:
        at = np.fromiter((m.start() for m in re.finditer(unit, text)), np.int64)
        marks = np.zeros(len(heads), bool)
        marks[np.flatnonzero(heads)[at]] = True
        return marks

    @staticmethod
    def _tree(counts: np.ndarray) -> np.ndarray:
        """Fenwick tree: entry i (from 1) sums the last ``i & -i`` blocks up to i."""
        tree = np.concatenate([np.zeros(1, np.int64), counts])
        step = 1
        while step < len(tree):
            below = np.arange(step, len(tree) - step, 2 * step)
            tree[below + step] += tree[below]
            step *= 2
        return tree

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before unit ``k`` (from 0); ``k`` = number of units gives the whole text."""
        place, left, points = 0, k, 0
        step = 1 << (len(self.units) - 1).bit_length()
        while step:
            following = place + step
            # all units of these blocks lie before the cut
            if following < len(self.units) and self.units[following] <= left:
                place, left, points = following, left - int(self.units[following]), points + int(self.points[following])
            step >>= 1
        start = place * self.block
        if start >= len(self.raw):
            return len(self.raw), points
        inside = np.flatnonzero(self.unit_heads[start : start + self.block])
        within = int(inside[left])
        return start + within, points + int(self.heads[start : start + within].sum())


def draws(doc_id: object, seed: int) -> list[int]:
    """Four numbers of 32 bits from a document's id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(
    doc_id: object, text: str | None, unit: str | None, seed: int, plain_percent: int, spm_percent: int
) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix, of middle, output) of one text."""
    text = text or ""
    tree = CutTree(text, unit)
    one, two, kind, order = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or kind % 100 >= 100 - plain_percent:
        return tree.n, "plain", None, None, text
    first, second = sorted((one % (tree.n + 1), two % (tree.n + 1)))
    (_, a), (_, b) = tree.cut(first), tree.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm_percent:
        return tree.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return tree.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    texts: DataFrame, unit: str | None = CODE_POINTS, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20
) -> DataFrame:
    """``texts`` with ``n_units``, ``form``, ``prefix_chars``, ``middle_chars`` (long) and ``infill`` (string).

    ``texts`` has ``doc_id`` and ``text``, one row per transcribed document; all other columns stay, but old ones of the
    new names give way. The prefix ends after the smaller of two numbers of units drawn from the id, the middle after the
    larger. ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` or ``plain``: the text as it is, for ``plain_percent``
    of the ids, for empty texts and for texts that hold one of the marks; both lengths, in code points, are then NULL.
    NULL texts count as empty, NULL ids as an empty id. A row's result depends on its id and text alone: repeated rows
    agree, empty tables stay empty, a long text costs its own task only.
    """
    form = "n long, form string, prefix long, middle long, output string"

    @F.pandas_udf(form)
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, rows in batches:
            ids = [None if pd.isna(i) else i for i in ids]
            cut = [rearranged(i, text, unit, seed, plain_percent, spm_percent) for i, text in zip(ids, rows)]
            frame = pd.DataFrame(cut, columns=["n", "form", "prefix", "middle", "output"])
            yield frame.astype({"n": "int64", "prefix": "Int64", "middle": "Int64"})

    # ids travel as text: a NULL among numbers would turn all of them into floating point
    cut = texts.withColumn("infill", split(F.col("doc_id").cast("string"), F.col("text")))
    parts = cut["infill"]
    return cut.withColumns({
        "n_units": parts["n"], "form": parts["form"], "prefix_chars": parts["prefix"],
        "middle_chars": parts["middle"], "infill": parts["output"],
    })


def restored(infill: Column, form: Column) -> Column:
    """The exact text again. A mark never stands in a part and never overlaps another, so each is found once."""
    parts = F.split(infill, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(infill)
    )

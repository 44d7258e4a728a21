"""Passages of hand-checked reference texts (goldens) that stand in transcribed texts.

A text that quotes a golden must not be learned from, or the golden measures nothing any more. Windows of
a text, as many words long as the golden, are compared with it:

* A window can only be similar to a golden if both hold one word shingle. So windows are laid where a
  shingle of a golden stands in the text, aligned with the golden; all others have similarity 0.
* Each window gets a SimHash of its shingles, weighted by their counts. Goldens stand in eight tables by
  one byte of their SimHash each, under every byte within two bits of it: a golden within ``RADIUS`` bits
  of a window is within two bits of it in one byte at least, so the tables give all of them.
* Each candidate is verified by the weighted similarity of the shingles themselves,
  ``sum(min(weights)) / sum(max(weights))``.

Goldens are a stated, bounded set; a large one is dealt with in parts of ``PART`` goldens, each against all texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A SimHash pair further apart than this is not looked at.
RADIUS = 23
#: Goldens that are broadcast at once.
PART = 4000
WORD = re.compile(r"\w+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_weights(words: list[str], size: int) -> Counter:
    return Counter(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def weighted_simhash(weights: Counter) -> int:
    hashes = np.array([xxhash.xxh64_intdigest(shingle) for shingle in weights], dtype=">u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    weight = np.array(list(weights.values()), dtype=np.int64)
    return int(np.packbits(2 * (bits * weight[:, None]).sum(axis=0) > weight.sum()).view(">u8")[0])


def weighted_similarity(a: Counter, b: Counter) -> float:
    least = sum(min(weight, b[shingle]) for shingle, weight in a.items())
    return least / (sum(a.values()) + sum(b.values()) - least)


class Goldens:
    """The reference texts of one part, ready for search. Texts without a word match nothing."""

    def __init__(self, texts: list[str | None], size: int):
        self.items = []
        words = [WORD.findall((text or "").lower()) for text in texts]
        self.anchors: dict[int, dict[str, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.tables = [defaultdict(list) for _ in range(8)]
        near = [0, *(1 << i for i in range(8)), *(1 << i | 1 << j for i, j in combinations(range(8), 2))]
        for number, own in enumerate(words):
            if not own:
                continue
            length = min(size, len(own))
            weights = shingle_weights(own, length)
            print_ = weighted_simhash(weights)
            at = len(self.items)
            self.items.append((number, len(own), length, weights, print_))
            for i in range(len(own) - length + 1):
                self.anchors[length][" ".join(own[i : i + length])].append((at, i))
            for byte in range(8):
                value = print_ >> 8 * byte & 255
                for change in near:
                    self.tables[byte][value ^ change].append(at)
        # ``hash`` differs between processes, so this is made where it is used
        self.prints = {
            length: np.unique(rolled(np.array([hash(w) for s in shingles for w in s.split(" ")], dtype=np.int64), length)[::length])
            for length, shingles in self.anchors.items()
        }

    def near(self, fingerprint: int) -> set[int]:
        found = set().union(*(self.tables[byte][fingerprint >> 8 * byte & 255] for byte in range(8)))
        return {at for at in found if (self.items[at][4] ^ fingerprint).bit_count() <= RADIUS}

    def leaks(self, text: str | None, threshold: float) -> list[tuple[int, int, int, float]]:
        """(golden, first word, words, similarity): the best window for each golden found."""
        words = WORD.findall((text or "").lower())
        hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
        windows: set[tuple[int, int, int]] = set()
        for length, shingles in self.anchors.items():
            if len(words) < length:
                continue
            keys = rolled(hashes, length)
            known = self.prints[length]
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            for at in np.flatnonzero(known[place] == keys).tolist():
                for item, offset in shingles.get(" ".join(words[at : at + length]), ()):
                    start = max(0, at - offset)
                    windows.add((start, min(len(words), at - offset + self.items[item][1]), length))
        best: dict[int, tuple[float, int, int]] = {}
        for start, stop, length in sorted(windows):
            weights = shingle_weights(words[start:stop], length)
            for item in self.near(weighted_simhash(weights)):
                if self.items[item][2] == length:
                    similarity = weighted_similarity(weights, self.items[item][3])
                    if similarity >= threshold and similarity > best.get(item, (0.0,))[0]:
                        best[item] = (similarity, start, stop - start)
        return [(self.items[item][0], start, n, s) for item, (s, start, n) in sorted(best.items())]


def rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` words."""
    words = hashes.view(np.uint64)
    out = np.zeros(len(words) - length + 1, dtype=np.uint64)
    for i in range(length):
        out = out * _FACTOR + words[i : len(words) - length + 1 + i]
    return out


def leaks_column(texts: DataFrame, goldens: DataFrame, threshold: float = 0.8, size: int = 5) -> Column:
    """array<struct<item_id, start_word, n_words, similarity>> of the column ``text``."""
    kind = goldens.schema["item_id"].dataType.simpleString()
    form = f"array<struct<item_id: {kind}, start_word: int, n_words: int, similarity: double>>"
    spark = texts.sparkSession
    parts = max(1, -(-goldens.count() // PART))
    dealt = goldens.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"))
    def search_in(part: int) -> Column:
        rows = sorted(dealt.filter(F.col("part") == part).select("item_id", "text").collect(), key=str)
        shared = spark.sparkContext.broadcast(([row["item_id"] for row in rows], [row["text"] for row in rows]))

        @F.pandas_udf(form)
        def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ids, golden_texts = shared.value
            goldens = Goldens(golden_texts, size)
            for batch in batches:
                yield pd.Series([
                    [(ids[item], start, n, s) for item, start, n, s in goldens.leaks(text, threshold)] for text in batch
                ])

        return search("text")

    return F.concat(*[search_in(part) for part in range(parts)])


def find_leaks(texts: DataFrame, goldens: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): every golden that a transcribed text holds, at its best window.

    ``texts`` has ``doc_id`` and ``text``, ``goldens`` ``item_id`` and ``text``. Words are runs of letters,
    digits and ``_``, in lower case; a golden of fewer than ``size`` words is one shingle. Of equally good
    windows the first counts. Texts and goldens that are NULL or have no word match nothing; repeated rows give
    repeated results; empty tables give an empty one. Other columns are not read.
    """
    found = texts.select("doc_id", F.explode(leaks_column(texts, goldens, threshold, size)).alias("leak"))
    return found.select("doc_id", "leak.*")


def without_leaks(texts: DataFrame, goldens: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``texts`` that hold no golden, unchanged."""
    return texts.filter(F.size(leaks_column(texts, goldens, threshold, size)) == 0)

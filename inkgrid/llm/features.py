"""Numbers made from texts for the classifiers of this subpackage, the same in every process."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from zlib import crc32

import numpy as np

WORD = re.compile(r"[^\W\d_]+")


def hashed_words(text: str | None, dims: int, prefix: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted indices (below ``dims``) of the words of a text and of their first ``prefix`` letters, and their values:
    1 + log of how often each stands in the text."""
    words = Counter(WORD.findall((text or "").lower()))
    starts: dict[str, int] = {}
    for word, n in words.items():
        if len(word) > prefix:
            starts[word[:prefix]] = starts.get(word[:prefix], 0) + n
    found = [crc32(word.encode()) for word in words]
    found += [crc32(start.encode(), 1) for start in starts]
    indices, place = np.unique(np.array(found, dtype=np.int64) % dims, return_inverse=True)
    counts = np.fromiter((*words.values(), *starts.values()), dtype=float)
    return indices, 1.0 + np.log(np.bincount(place, counts, minlength=len(indices)))


@dataclass
class SparseRows:
    """Rows of indices and values, one after another, and the row number of each."""

    indices: np.ndarray
    values: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> SparseRows:
        rows = list(rows)
        row = np.repeat(np.arange(len(rows)), [len(indices) for indices, _ in rows])
        empty = [(np.zeros(0, dtype=np.int64), np.zeros(0))]
        indices, values = (np.concatenate(side) for side in zip(*rows or empty))
        return cls(indices.astype(np.int64), values.astype(float), row, len(rows))


#: Classes of bytes: lower, upper, digit, space, line feed, sentence marks, other marks, letters beyond ASCII.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:?'-"]] = 5
_CLASS[128:] = 7
CLASSES = 8
CONTENT_DIMS = CLASSES * CLASSES + 6


def content_features(text: str | None) -> np.ndarray:
    """How a text is written: shares of byte-class pairs, word lengths and repetition, by root to spread small shares."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros(CONTENT_DIMS)
    if len(raw) < 2:
        return out
    kinds = _CLASS[raw]
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(raw) - 1))
    words, lines = text.split(), text.split("\n")
    if words:
        lengths = np.fromiter(map(len, words), dtype=float)
        out[-6:] = (
            np.log1p(lengths.mean()) / 3, np.log1p(lengths.std()) / 3, len(set(words)) / len(words),
            len(set(lines)) / len(lines), np.log1p(len(words)) / 10, np.log1p(len(words) / len(lines)) / 5,
        )
    return out


METADATA_DIMS = 128


def metadata_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """What is known of a document without reading it: language, source and size, each as one of several bins."""
    out = np.zeros(METADATA_DIMS)
    out[crc32((lang or "").encode()) % 32] = 1
    out[32 + crc32((source or "").encode()) % 64] = 1
    known = n_chars is not None and n_chars == n_chars
    out[96 + (1 + min(30, int(2 * np.log2(max(1.0, n_chars)))) if known else 0)] = 1
    return out

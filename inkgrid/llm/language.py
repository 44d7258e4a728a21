"""Language of a text by prediction with partial matching (PPM).

Each language has a variable-order tree of byte contexts with counts. The price of a byte is the
code length an arithmetic coder with these frozen counts would spend: in the longest known context
``-log2(n / (total + distinct))`` if the byte was seen there, else the escape price
``-log2(distinct / (total + distinct))`` plus the price in the next shorter context, down to eight
bits for a byte never seen at all. The language with the shortest code wins.

Trees are fitted on a bounded sample (``per_language`` texts of at most ``max_chars`` characters,
drawn by a hash of the text); prediction reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes before the first one of a text.
START = b"\n"
#: Bytes priced at once.
BLOCK = 1 << 17
UNKNOWN = "und"


def packed(data: np.ndarray, order: int) -> np.ndarray:
    """The last ``order + 1`` bytes up to each position as one number, newest byte lowest."""
    out = data.astype(np.uint64)
    for back in range(1, order + 1):
        out[back:] |= data[:-back].astype(np.uint64) << np.uint64(8 * back)
    return out


class ContextTrees:
    """Frozen trees of all languages: per order the grams with their resolved price in each language,
    and the contexts with their escape price."""

    def __init__(self, languages: list[str], counts: pd.DataFrame, order: int):
        self.languages, self.order = languages, order
        at = {name: i for i, name in enumerate(languages)}
        self.grams, self.price, self.contexts, self.escape = [], [], [], []
        for k in range(order + 1):
            part = counts[counts["k"] == k]
            grams, row = np.unique(part["gram"].to_numpy().astype(np.uint64), return_inverse=True)
            seen = np.zeros((len(grams), len(languages)))
            np.add.at(seen, (row, part["lang"].map(at).to_numpy(dtype=int)), part["n"].to_numpy())
            contexts, parent = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((2, len(contexts), len(languages)))
            np.add.at(total, parent, seen)
            np.add.at(distinct, parent, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                known = -np.log2(seen / (total + distinct)[parent])
            if k:
                lower = self.price[k - 1][np.searchsorted(self.grams[k - 1], grams & np.uint64((1 << 8 * k) - 1))]
            else:
                lower = np.full(seen.shape, 8.0)
            self.grams.append(grams)
            self.price.append(np.where(seen > 0, known, escape[parent] + lower))
            self.contexts.append(contexts)
            self.escape.append(escape)

    def prices(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language; contexts reach back within ``data``."""
        out = np.zeros((len(data), len(self.languages)))
        rest = np.arange(len(data))
        keys = packed(data, self.order)
        for k in range(self.order, -1, -1):
            grams = keys[rest] & np.uint64((1 << 8 * (k + 1)) - 1)
            place = np.minimum(np.searchsorted(self.grams[k], grams), len(self.grams[k]) - 1)
            hit = self.grams[k][place] == grams
            out[rest[hit]] += self.price[k][place[hit]]
            rest, grams = rest[~hit], grams[~hit] >> np.uint64(8)
            if not len(rest):
                return out
            place = np.minimum(np.searchsorted(self.contexts[k], grams), len(self.contexts[k]) - 1)
            hit = self.contexts[k][place] == grams
            out[rest[hit]] += self.escape[k][place[hit]]
        out[rest] += 8.0
        return out

    def code_lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and its bytes."""
        pad, bits = START * self.order, np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, bytes]] = []
        size = 0

        def settle() -> None:
            data = np.frombuffer(b"".join(piece for _, piece in held), dtype=np.uint8)
            price, start = self.prices(data), 0
            for i, piece in held:
                bits[i] += price[start + self.order : start + len(piece)].sum(axis=0)
                start += len(piece)

        for i, text in enumerate(texts):
            raw = pad + text.lower().encode("utf-8", "replace")
            sizes[i] = len(raw) - self.order
            for start in range(0, max(1, sizes[i]), BLOCK):
                held.append((i, raw[start : start + BLOCK + self.order]))
                size += len(held[-1][1])
                if size >= BLOCK:
                    settle()
                    held, size = [], 0
        if held:
            settle()
        return bits, sizes


def labelled_sample(labelled: DataFrame, per_language: int, max_chars: int) -> DataFrame:
    """At most ``per_language`` different texts of each language, chosen by a hash of the text."""
    usable = labelled.select("lang", "text", F.xxhash64("text").alias("draw")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= max_chars)
    )
    sizes = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return usable.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, 2.0 * per_language / n))])
    drawn = usable.filter(F.pmod("draw", F.lit(1_000_003)) / 1_000_003 < share[F.col("lang")])
    ranked = drawn.dropDuplicates(["lang", "draw"]).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    )
    return ranked.filter(F.col("place") <= per_language).select("lang", "text")


def gram_counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, k, gram, n): how often a byte followed each context of ``k`` bytes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                held, size = [], 0
                for i, text in enumerate(texts, 1):
                    raw = START * order + text.lower().encode("utf-8", "replace")
                    held.append(packed(np.frombuffer(raw, dtype=np.uint8), order)[order:])
                    size += len(raw)
                    if size < BLOCK and i < len(texts):
                        continue
                    keys = np.concatenate(held)
                    held, size = [], 0
                    for k in range(order + 1):
                        grams, n = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "k": k, "gram": grams.astype(np.int64), "n": n})

    counted = sample.select("lang", "text").mapInPandas(count, "lang string, k int, gram long, n long")
    return counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def fit_trees(labelled: DataFrame, order: int = 3, per_language: int = 1500, max_chars: int = 50_000) -> ContextTrees | None:
    """Trees of the languages in ``labelled`` (``lang``, ``text``); None where nothing is labelled.

    The counts that come to the driver are those of the bounded sample.
    """
    counts = gram_counts(labelled_sample(labelled, per_language, max_chars), order).toPandas()
    if counts.empty:
        return None
    return ContextTrees(sorted(counts["lang"].unique()), counts, order)


def identify_languages(spark: SparkSession, texts: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """The language of every transcribed text.

    ``texts`` has ``doc_id`` and ``text``; all columns stay. New ones (an old column of the same name
    gives way): ``lang_pred``, ``score`` (share of the winner when code lengths are read as
    probabilities, 0 to 1) and ``bits_per_byte`` of the winning code.

    A NULL text, one without a letter, and any text when ``trees`` is None have ``und``, 0.0 and NULL.
    Equal code lengths go to the first language in alphabetical order. Rows are judged one by one, so
    repeated rows have equal results; an empty table stays empty.
    """
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for batch in batches:
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(batch), "score": 0.0, "bits_per_byte": np.nan})
            rows = [i for i, text in enumerate(batch) if text is not None and any(map(str.isalpha, text))] if trees else []
            if rows:
                bits, sizes = trees.code_lengths([batch.iloc[i] for i in rows])
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                out.loc[rows, "lang_pred"] = np.array(trees.languages, dtype=object)[best]
                out.loc[rows, "score"] = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                out.loc[rows, "bits_per_byte"] = least / sizes
            yield out

    judged = texts.withColumn("lang_pred", judge("text"))
    fields = judged["lang_pred"]
    return judged.withColumns({
        "score": fields["score"],
        "bits_per_byte": F.nanvl(fields["bits_per_byte"], F.lit(None).cast("double")),
        "lang_pred": fields["lang_pred"],
    })


def recognised() -> Column:
    """Whether a judged text is in one of the learned languages: its code is shorter than its bytes."""
    return F.coalesce((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < 8.0), F.lit(False))

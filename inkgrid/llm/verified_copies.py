"""One transcribed text of each group of similar ones: SimHash by classes of shingles, pivot tables, exact similarity.

``near_copies`` links fingerprints of whole texts a few bits apart; texts that share four fifths of their shingles may lie
twenty bits apart. Here every text carries several fingerprints, each over the shingles of one *hash class*, so that a few
changed words leave most of them equal:

1. One fingerprint of the whole text, and one for each of ``CLASSES`` hash classes at two *levels*: with 2 ** level classes
   a class holds four to eight shingles of the text, or half as many. Texts of about the same length share a level.
2. Different texts that agree in a class fingerprint meet in a bucket, each with each. Distances to ``PIVOTS`` reference
   fingerprints, a row a text, discard a pair if any coordinate differs by more than ``radius`` bits; then the fingerprints
   themselves are compared.
3. Of what is left the exact similarity is computed: common shingles by all different ones.
4. Texts are gone through in the order of a hash: one stays if it is similar to none that stays before it. So every text
   that goes is similar to one that stays, no two that stay and meet in a bucket are similar, and no chain of links takes a
   text along. A text is compared with those that stay, so a bucket of thousands of similar texts needs no pair of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import free_name, kept
from inkgrid.llm.near_copies import reference_fingerprints

CLASSES = 16
#: Pairs of similarity 0.8 were at most 19 bits apart in all measurements.
RADIUS = 23
#: Rounds in which texts that meet none before them settle; what is left then meets under rare shingles.
ROUNDS = 3
#: Words of 64 bits in which texts are marked by their shingles; a power of two.
MARKS = 4
#: Odd, so that products lose nothing.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """Hashes of the different runs of ``size`` lower-cased words; of the whole text if it has fewer, none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        runs = runs * _STEP + _mixed(hashes[i : len(words) - size + 1 + i])
    return np.unique(_mixed(runs))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _packed(over_half: np.ndarray) -> np.ndarray:
    return np.packbits(over_half, axis=1).view(">i8")[:, 0].astype(np.int64)


def whole_fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += _bits(hashes[at : at + _BLOCK]).sum(axis=0, dtype=np.int64)
    return int(_packed((2 * ones > len(hashes))[None, :])[0])


def class_keys(hashes: np.ndarray) -> list[int]:
    """Level, class and fingerprint of the class's shingles, hashed to one number each."""
    level = max(0, int(len(hashes) / 4).bit_length() - 1)
    keys: list[int] = []
    for k in (level, level + 1):
        # the low bits choose the class; they are equal in all of it and say nothing about it
        classes = (hashes & np.uint64((1 << k) - 1)).astype(np.int64)
        own = classes < CLASSES
        order = np.argsort(classes[own], kind="stable")
        of, members = classes[own][order], hashes[own][order]
        if not len(of):
            continue
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        counts = np.diff(np.append(starts, len(of)))
        ones = np.add.reduceat(_bits(_mixed(members)).astype(np.int64), starts, axis=0)
        prints = _packed(2 * ones > counts[:, None]).view(np.uint64)
        tags = of[starts].astype(np.uint64) + np.uint64(k * CLASSES + 1)
        keys += _mixed(prints ^ _mixed(tags * _STEP)).view(np.int64).tolist()
    return keys


def _bucketed(texts: DataFrame, size: int) -> DataFrame:
    """(key, node, fingerprint): different texts, as their hashes, under each class fingerprint that several share."""

    @F.pandas_udf("struct<fingerprint: long, keys: array<long>>")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingle_hashes(text, size) for text in batch]
            yield pd.DataFrame({
                "fingerprint": pd.Series([whole_fingerprint(h) for h in hashes], dtype="int64"),
                "keys": [class_keys(h) for h in hashes],
            })

    made = texts.select(F.xxhash64("text").alias("node"), printed("text").alias("p"))
    # copies have equal keys: one row for each text, its keys still together, is what is shuffled and written
    prints = kept(made.groupBy("node").agg(F.first("p").alias("p")))
    rows = prints.select(F.explode("p.keys").alias("key"), "node", "p.fingerprint")
    several = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return kept(rows.join(several, "key", "left_semi"))


def _lower(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("of_low"), F.col("node").alias("low"), F.col("fingerprint").alias("print_of_low"))


def _meets(radius: int) -> Column:
    """A row and one of ``_lower`` under the same key, no more than ``radius`` bits apart."""
    return (F.col("key") == F.col("of_low")) & _near("fingerprint", "print_of_low", radius)


def close_pairs(rows: DataFrame, lower: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(high, low): nodes of ``rows`` and ``lower`` (both as ``_bucketed`` gives them) that meet under a key."""
    met = rows.join(_lower(lower), _meets(radius) & (F.col("low") < F.col("node")))
    return met.select(F.col("node").alias("high"), "low").distinct()


def _near(a: str, b: str, radius: int) -> Column:
    """Pivot rows first, then the fingerprints themselves."""
    near = F.lit(True)
    for pivot in reference_fingerprints().view(np.int64).tolist():
        gap = F.bit_count(F.col(a).bitwiseXOR(F.lit(pivot))) - F.bit_count(F.col(b).bitwiseXOR(F.lit(pivot)))
        near = near & (F.abs(gap) <= radius)
    return near & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius)


def _shingle_sets(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the texts in question, written once."""

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_hashes(text, size).view(np.int64) for text in batch])

    # one row a text: of copies the first that comes
    asked = texts.select(F.xxhash64("text").alias("node"), "text").join(nodes.select("node").distinct(), "node", "left_semi")
    return kept(asked.groupBy("node").agg(F.first("text").alias("text")).select("node", hashed("text").alias("shingles")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose exact similarity is high enough."""
    high = sets.select(F.col("node").alias("high"), F.col("shingles").alias("h"))
    low = sets.select(F.col("node").alias("low"), F.col("shingles").alias("l"))
    common = F.size(F.array_intersect("h", "l"))
    return pairs.join(high, "high").join(low, "low").filter(
        common >= similarity * (F.size("h") + F.size("l") - common) - 1e-9
    ).select("high", "low")


def _prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(high, low): a pair for all texts that may be similar, from rare shingles; none that is similar is missing.

    Shingles of a text stand in one order for all texts, the rarest first. Texts of this similarity have so many in common
    that the first common one stands among the first of both, and that enough stand behind it in both. Each shingle turns one
    of ``MARKS`` x 64 bits over, so no more bits of two texts differ than shingles that only one of them has.
    """
    marks = F.array(*[
        F.expr(f"aggregate(shingles, 0L, (a, s) -> IF(((s >> 6) & {MARKS - 1}) = {k}, a ^ shiftleft(1L, CAST(s & 63 AS INT)), a))")
        for k in range(MARKS)
    ])
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    placed = each.join(often, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    first = F.slice("s", F.lit(1), (F.col("n") - F.ceil(similarity * F.col("n") - 1e-6) + 1).cast("int"))
    told = placed.select("node", "n", F.posexplode(first).alias("at", "s")).filter("s.often > 1")
    told = kept(told.select("node", (F.col("n") - F.col("at")).alias("behind"), "n", "s.shingle"))
    told = told.join(sets.select("node", marks.alias("marks")), "node")
    low = told.select(
        F.col("node").alias("low"), F.col("behind").alias("b"), F.col("n").alias("m"), F.col("shingle").alias("t"),
        F.col("marks").alias("marks_of_low"),
    )
    differing = reduce(Column.__add__, [F.bit_count(F.get("marks", F.lit(k)).bitwiseXOR(F.get("marks_of_low", F.lit(k)))) for k in range(MARKS)])
    enough_alike = differing <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("m")) + 1e-6
    enough = F.least("behind", "b") >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6
    met = told.join(low, (F.col("shingle") == F.col("t")) & (F.col("low") < F.col("node")) & enough & enough_alike)
    return met.select(F.col("node").alias("high"), "low").distinct()


def _partnered(rows: DataFrame, radius: int) -> DataFrame:
    """The rows that meet another one, written once."""
    return kept(rows.join(_lower(rows), _meets(radius) & (F.col("low") != F.col("node")), "left_semi"))


def similar_pairs(texts: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = RADIUS) -> DataFrame:
    """(high, low): hashes (``xxhash64``) of different texts of at least this similarity, low < high, written once.

    All pairs under each key: their number grows with the square of a group of similar texts.
    """
    rows = _partnered(_bucketed(texts, size), radius)
    return kept(_verified(close_pairs(rows, rows, radius), _shingle_sets(texts, rows, size), similarity))


def superfluous_texts(
    texts: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = RADIUS, rounds: int = ROUNDS
) -> DataFrame:
    """(node): what ``superfluous`` finds among all ``similar_pairs``, without making them all.

    In each round the nodes that meet no lower one stay. All that meet them are compared with them, and those similar go;
    what is left meets only others that are left. A group of similar texts so costs a pair a text. Texts that are close but
    not similar settle one a round: after ``rounds`` what is left meets under its rare shingles.
    """
    rows = _partnered(_bucketed(texts, size), radius)
    sets, gone = _shingle_sets(texts, rows, size), []
    while not rows.isEmpty():
        if len(gone) == rounds:
            rest = kept(sets.join(rows.select("node").distinct(), "node", "left_semi"))
            gone.append(superfluous(kept(_verified(_prefix_pairs(rest, similarity), rest, similarity))))
            break
        above = _meets(radius) & (F.col("low") < F.col("node"))
        later = kept(rows.join(_lower(rows), above, "left_semi").select("node").distinct())
        free = rows.join(later, "node", "left_anti")
        pairs = close_pairs(rows.join(later, "node", "left_semi"), free, radius)
        going = kept(_verified(pairs, sets, similarity).select(F.col("high").alias("node")).distinct())
        gone.append(going)
        rows = kept(rows.join(later, "node", "left_semi").join(going, "node", "left_anti"))
    return reduce(DataFrame.unionByName, gone) if gone else rows.select("node")


def superfluous(links: DataFrame) -> DataFrame:
    """(node): what goes if nodes are gone through in order and each stays that is linked to none that stays before it.

    A node without a lower link stays, what is linked to it from above goes, and both leave the graph; hashes order the
    nodes at random, so few rounds are needed whatever the shape of the graph.
    """
    gone = None
    while not links.isEmpty():
        highs = links.select("high").distinct()
        staying = links.select("low").distinct().join(highs, F.col("low") == F.col("high"), "left_anti")
        going = kept(links.join(staying, "low", "left_semi").select(F.col("high").alias("node")).distinct())
        gone = going if gone is None else gone.unionByName(going)
        links = kept(
            links.join(going, links["high"] == going["node"], "left_anti").join(
                going, F.col("low") == going["node"], "left_anti"
            )
        )
    return gone if gone is not None else links.select(F.col("high").alias("node"))


def without_similar(texts: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``texts`` (``doc_id``, ``text``; other columns stay) without those similar to one that stays.

    Similarity is that of the sets of ``size``-word runs, words lower-cased (A-Z) and parted by white space. Of texts that
    are equal the row with the smallest ``doc_id`` stays, NULL ids last; of rows that repeat id and text one. NULL counts as
    a text of its own, and so does the empty one; texts without words are similar to none but their copies. Which of several
    similar texts stays is decided by a hash. An empty table gives an empty one.
    """
    node, first = free_name(texts, "node"), free_name(texts, "first_id")
    hashed = texts.withColumn(node, F.xxhash64("text"))
    gone = superfluous_texts(texts.select("text"), similarity, size)
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    stay = hashed.select(node, "doc_id").groupBy(node).agg(F.min(rank)["doc_id"].alias(first))
    stay = stay.join(gone, stay[node] == gone["node"], "left_anti").withColumnRenamed(node, f"{node}_")
    found = hashed.join(
        stay, (hashed[node] == stay[f"{node}_"]) & hashed["doc_id"].eqNullSafe(stay[first]), "left_semi"
    )
    # only rows that repeat id and text are shuffled to part with their copies
    again, repeated_id = free_name(texts, "again"), free_name(texts, "repeated_id")
    repeated = hashed.groupBy("doc_id", node).count().filter("count > 1")
    repeated = repeated.select(F.col("doc_id").alias(repeated_id), F.col(node).alias(again))
    same = (found[node] == repeated[again]) & found["doc_id"].eqNullSafe(repeated[repeated_id])
    single, several = found.join(repeated, same, "left_anti"), found.join(repeated, same, "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", node])).drop(node)

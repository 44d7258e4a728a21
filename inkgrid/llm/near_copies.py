"""Near copies among transcribed texts: SimHash fingerprints linked through pivot distance tables.

Links are found among *different* fingerprints only, so a thousand exact copies are one entry:

1. Two fingerprints at distance 3 or less agree on at least three of six bit blocks. Each fingerprint
   stands under the twenty triples of blocks; entries alone under a triple drop out at once.
2. Under each triple, fingerprints carry a row of the pivot table (Hamming distances to ``PIVOTS``
   reference fingerprints). By the triangle inequality a pair whose rows differ by more than 3 in any
   coordinate cannot be linked; only the others are verified bit by bit.
3. Of what is linked under one triple only a spanning forest is handed on, never all pairs. A triple
   with more than ``TILE`` entries is cut into tiles of two groups each, which together hold every
   pair, so that no task gets all of it.
4. Connected components by alternating large and small stars, lineage cut each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.common import free_name, kept

RADIUS = 3
WIDTHS = (11, 11, 11, 11, 10, 10)
PIVOTS = 24
TILE = 2048
#: Groups up to this size are compared by shifted columns, larger ones by search.
SMALL = 12
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint_of(text: str | None, size: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles, as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = (ends - [len(word) + 1 for word in words])[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])), dtype=">u8"
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def fingerprints(texts: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """``texts`` with ``fingerprint`` (bigint) from ``text``; NULL and blank texts have 0."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(text, size, seed) for text in batch], dtype="int64")

    return texts.withColumn("fingerprint", hashed("text"))


def reference_fingerprints() -> np.ndarray:
    """The pivots: fixed, spread evenly by hashing their number."""
    return np.array([xxhash.xxh64_intdigest(str(i)) for i in range(PIVOTS)], dtype=np.uint64)


def block_masks() -> list[int]:
    """Bit masks of all triples of blocks, as signed numbers."""
    blocks, at = [], 0
    for width in WIDTHS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    masks = [a | b | c for a, b, c in combinations(blocks, len(WIDTHS) - RADIUS)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def search_links(fps: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links in one group: each found entry looks through those not yet found."""
    free = np.arange(len(fps))
    while len(free):
        queue, free = [free[0]], free[1:]
        while queue and len(free):
            at = queue.pop()
            near = np.abs(table[free] - table[at]).max(axis=1) <= RADIUS
            near[near] = np.bitwise_count(fps[free[near]] ^ fps[at]) <= RADIUS
            if near.any():
                found, free = free[near], free[~near]
                yield np.full(len(found), fps[at]), fps[found]
                queue.extend(found)


def shifted_links(group: np.ndarray, fps: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links in many small groups, standing one after another: each entry against the next ones."""
    for shift in range(1, SMALL):
        left = np.flatnonzero(group[:-shift] == group[shift:]) if shift < len(group) else []
        if not len(left):
            return
        left = left[np.abs(table[left] - table[left + shift]).max(axis=1) <= RADIUS]
        left = left[np.bitwise_count(fps[left] ^ fps[left + shift]) <= RADIUS]
        yield fps[left], fps[left + shift]


def links(different: DataFrame) -> DataFrame:
    """(a, b), a < b: enough of the links between ``fingerprint`` rows (all different) to connect what is linked."""
    triples = F.array(*[
        F.struct(F.lit(i).cast("byte").alias("triple"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("part"))
        for i, mask in enumerate(block_masks())
    ])
    under = different.select("fingerprint", F.explode(triples).alias("at")).select("fingerprint", "at.*")
    many = under.withColumn("n", F.count("*").over(Window.partitionBy("triple", "part"))).filter("n > 1")
    groups = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("fingerprint"), groups).cast("int")
    tiled = many.withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1))).select(
        "triple", "part", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"), "fingerprint"
    )
    keys = ["triple", "part", "low", "high"]
    pivots = reference_fingerprints()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            # the last group may go on in the next batch
            last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
            rest = batch[last]
            yield from compared(batch[~last])
        if rest is not None:
            yield from compared(rest)

    def compared(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if rows.empty:
            return
        values = rows[keys].to_numpy(dtype=np.int64)
        group = np.concatenate([[0], np.cumsum((values[1:] != values[:-1]).any(axis=1))])
        fps = rows["fingerprint"].to_numpy().view(np.uint64)
        table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
        sizes = np.bincount(group)
        small = (sizes <= SMALL)[group]
        found = list(shifted_links(group[small], fps[small], table[small]))
        for start, size in zip(np.cumsum(sizes) - sizes, sizes):
            if size > SMALL:
                found += search_links(fps[start : start + size], table[start : start + size])
        if found:
            a, b = (np.concatenate(side).view(np.int64) for side in zip(*found))
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = tiled.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node on an edge but roots themselves.

    Alternates large stars (larger neighbours to the least neighbour) and small stars (smaller neighbours to
    the least) until the edges are stars and stay the same.
    """
    edges = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def _printed(texts: DataFrame, size: int, seed: int) -> DataFrame:
    """(doc_id, text_hash, fingerprint) of every text, written once."""
    hashed = fingerprints(texts.select("doc_id", "text"), size, seed)
    return kept(hashed.select("doc_id", F.xxhash64("text").alias("text_hash"), "fingerprint"))


def _roots(printed: DataFrame) -> DataFrame:
    """(fingerprint, root): a number for each class of linked fingerprints."""
    different = printed.select("fingerprint").distinct()
    roots = components(links(different))
    return different.join(roots, different["fingerprint"] == roots["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )


def near_copies(texts: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """One row per transcribed text with the class of near copies it belongs to.

    ``texts`` has ``doc_id`` (a number or string) and ``text``. Returned are ``doc_id``, ``fingerprint``
    (bigint) and ``component_id``: the smallest ``doc_id`` among all texts reachable over links, itself
    included. Fingerprints link when at most 3 of their 64 bits differ, and texts of one fingerprint always do.

    NULL and blank texts have fingerprint 0 and link like any other. Repeated rows stay, each with the same
    class. A NULL ``doc_id`` counts for linking but not as the smallest. An empty table gives an empty one.
    """
    printed = _printed(texts, size, seed)
    first = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    rooted = kept(_roots(printed).join(first, "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return printed.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(texts: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``texts`` without near copies: of each class the text with the smallest ``doc_id`` stays, unchanged.

    Ids that are NULL come last. Of rows repeating ``doc_id`` and ``text`` one stays.
    """
    printed = _printed(texts, size, seed)
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    # a fingerprint may be that of very many texts: first the least of each, then the least of each class
    least = printed.groupBy("fingerprint").agg(F.min(rank).alias("first"))
    stay = least.join(_roots(printed), "fingerprint").groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.doc_id").alias("stay_id"), F.col("first.text_hash").alias("stay_hash"))
    own = free_name(texts, "text_hash")
    hashed = texts.withColumn(own, F.xxhash64("text"))
    found = hashed.join(stay, hashed["doc_id"].eqNullSafe(stay["stay_id"]) & (hashed[own] == stay["stay_hash"]), "left_semi")
    return found.dropDuplicates(["doc_id", own]).drop(own)

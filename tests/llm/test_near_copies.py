import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from inkgrid.llm import near_copies
from tests.llm.tables import documents, odd_texts, prose, rng


def print_by_hand(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    size = min(3, len(words))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    out = sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))
    return out - (1 << 64) if out >> 63 else out


def classes_by_hand(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_classes_equal_brute_force(spark):
    r = rng(9)
    texts = []
    for _ in range(30):
        base = prose(r, lines=8).split(" ")
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            copy[r.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), *odd_texts()]
    rows = [(1000 - i, t, "en") for i, t in enumerate(texts)]
    got = {row["doc_id"]: row for row in near_copies.near_copies(documents(spark, rows)).collect()}
    prints = [print_by_hand(t) for t in texts]
    classes = classes_by_hand(prints)
    least = {c: min(1000 - i for i, d in enumerate(classes) if d == c) for c in classes}
    assert len(got) == len(rows)
    for i, (own, c) in enumerate(zip(prints, classes)):
        assert got[1000 - i]["fingerprint"] == own
        assert got[1000 - i]["component_id"] == least[c]


def test_links_connect_dense_and_sparse_groups(spark, monkeypatch):
    """Balls of fingerprints around few centres, small tiles: chains must not break."""
    monkeypatch.setattr(near_copies, "TILE", 16)
    r = random.Random(4)
    prints = set()
    for _ in range(6):
        at = r.getrandbits(64)
        for _ in range(150):
            for bit in r.sample(range(64), r.randint(1, 3)):
                at ^= 1 << bit
            prints.add(at)
            if r.random() < 0.1:
                at = r.choice(sorted(prints))
    signed = [int(np.uint64(p).view(np.int64)) for p in sorted(prints)]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(5)
    edges = near_copies.links(frame)
    roots = {row["node"]: row["root"] for row in near_copies.components(edges).collect()}
    classes = classes_by_hand(signed)
    got = [roots.get(p, p) for p in signed]
    assert len(set(zip(got, classes))) == len(set(got)) == len(set(classes))


def test_long_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    roots = {row["node"]: row["root"] for row in near_copies.components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 201)} | {901: 900}


def test_one_of_each_and_odd_tables(spark):
    r = rng(11)
    text = prose(r)
    other = prose(r)
    rows = [(5, text, "en"), (3, text.upper(), "en"), (3, text.upper(), "en"), (None, text, "en"), (None, other, "en"), (8, None, None), (9, "", None)]
    table = documents(spark, rows).withColumns({"fingerprint": F.lit("x"), "text_hash": F.lit("y"), "root": F.lit(0)})
    stay = near_copies.one_of_each(table)
    assert stay.columns == table.columns
    assert sorted(((row["doc_id"], row["text"]) for row in stay.collect()), key=str) == sorted(
        [(3, text.upper()), (None, other)] + [(8, None)], key=str
    )
    assert near_copies.near_copies(table).count() == len(rows)
    assert near_copies.near_copies(documents(spark, [])).count() == near_copies.one_of_each(documents(spark, [])).count() == 0
    named = table.withColumn("doc_id", F.concat(F.lit("upload-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    assert near_copies.near_copies(named).filter("component_id = 'upload-3'").count() == 4

import numpy as np
from pyspark.sql import functions as F

from inkgrid.llm import verified_copies as vc
from tests.llm.tables import documents, odd_texts, prose, rng


def shingles_by_hand(text, size=5):
    words = "".join(c.lower() if c < "\x80" else c for c in text or "").encode().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def similarity(a, b):
    one, other = shingles_by_hand(a), shingles_by_hand(b)
    return len(one & other) / len(one | other) if one and other else 0.0


def hashes_of(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "i long, text string")
    return {r.i: r.h for r in rows.select("i", F.xxhash64("text").alias("h")).collect()}


def staying_by_hand(spark, texts):
    """In the order of hashes: the smallest id of each text that is similar to none that stays before it."""
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    order = hashes_of(spark, texts)
    stay = {}
    for text, i in sorted(first.items(), key=lambda p: order[p[1]]):
        if all(similarity(text, other) < 0.8 for other in stay.values()):
            stay[i] = text
    return stay


def edited(r, text, share):
    words = text.split(" ")
    for k in r.sample(range(len(words)), max(1, int(share * len(words)))):
        words[k] = "changed" + str(r.random())
    return " ".join(words)


def test_hashes_are_those_of_different_runs():
    for text in (*odd_texts(), "a b c d e f", "A b C d e F", "one two"):
        assert len(vc.shingle_hashes(text)) == len(shingles_by_hand(text))
    assert list(vc.shingle_hashes("A b c d e")) == list(vc.shingle_hashes("a B\tc\nd  e"))


def test_equals_brute_force(spark):
    r = rng(51)
    texts = [prose(r, lines=3, words=r.randint(8, 90)) for _ in range(60)]
    texts += [edited(r, texts[i % 60], share) for i, share in enumerate([0.005, 0.01, 0.02, 0.03] * 30)]
    # a chain: neighbours are similar, its ends are not
    chain = prose(r, lines=1, words=120)
    for k in range(12):
        chain = edited(r, chain, 0.01)
        texts.append(chain)
    texts += [texts[0], texts[0].upper(), "one two three", "one two three"] + [t for t in odd_texts() if t is not None]
    rows = dict(enumerate(texts))
    table = documents(spark, [(i, t, "en") for i, t in rows.items()]).withColumns({"node": F.lit(1), "FIRST_ID": F.lit(2)})
    out = vc.without_similar(table)
    assert out.columns == table.columns
    assert {row["doc_id"]: row["text"] for row in out.collect()} == staying_by_hand(spark, rows)


def test_most_similar_pairs_are_found(spark):
    r = rng(52)
    base = [prose(r, lines=1, words=r.randint(40, 400)) for _ in range(400)]
    copies = [edited(r, text, r.uniform(0, 0.025)) for text in base]
    pairs = [(a, b) for a, b in zip(base, copies) if 0.8 <= similarity(a, b) < 1]
    rows = {i: t for i, t in enumerate(base + copies)}
    found = {frozenset((p.high, p.low)) for p in vc.similar_pairs(documents(spark, [(i, t, "en") for i, t in rows.items()])).collect()}
    hashes = {text: h for text, h in zip(rows.values(), hashes_of(spark, rows).values())}
    caught = sum(frozenset((hashes[a], hashes[b])) in found for a, b in pairs)
    assert len(pairs) > 150 and caught >= 0.95 * len(pairs)
    apart = [np.bitwise_count(np.uint64(vc.whole_fingerprint(vc.shingle_hashes(a)) & (2**64 - 1))
                              ^ np.uint64(vc.whole_fingerprint(vc.shingle_hashes(b)) & (2**64 - 1))) for a, b in pairs]
    assert max(apart) <= vc.RADIUS


def test_nulls_repeats_and_empty_tables(spark):
    table = documents(spark, [(None, "a b", None), (3, "a b", None), (2, "a b", None), (2, "a b", None), (4, None, None), (5, None, None), (6, "", None)])
    out = sorted((row["doc_id"], row["text"]) for row in vc.without_similar(table).collect())
    assert out == [(2, "a b"), (4, None), (6, "")]
    assert vc.without_similar(documents(spark, [])).count() == 0
    named = documents(spark, [(1, "x y", None), (2, "x y", None)]).withColumn("doc_id", F.concat(F.lit("card"), "doc_id"))
    assert [row["doc_id"] for row in vc.without_similar(named).collect()] == ["card1"]


def unseen_edits(r, text, n):
    """``n`` words changed so that no shingle of a hash class comes or goes: the class fingerprints stay."""
    words, at = text.split(" "), r.randrange(5, 20)
    level = max(0, int(len(vc.shingle_hashes(text)) / 4).bit_length() - 1)

    def unseen(word):
        near = vc.shingle_hashes(" ".join([*words[at - 4 : at], word, *words[at + 1 : at + 5]]))
        return all(near & np.uint64((1 << level) - 1) >= vc.CLASSES)

    while n and at < len(words) - 5:
        tried = (f"w{r.randrange(10**9)}" for _ in range(100))
        word = next(filter(unseen, tried), None) if unseen(words[at]) else None
        if word:
            words[at], n = word, n - 1
        at += 5 if word else 1
    assert n == 0
    return " ".join(words)


def test_texts_that_meet_under_a_stranger_are_compared(spark):
    """Two similar texts whose buckets are all led by a third, similar to neither: they were never compared."""
    r = rng(54)
    base = " ".join(f"b{r.randrange(10**9)}" for _ in range(300))
    twin = unseen_edits(r, base, 1)
    strangers = [unseen_edits(r, base, 12) for _ in range(6)]
    order = hashes_of(spark, dict(enumerate([base, twin, *strangers])))
    least = min(range(2, 8), key=order.get)
    assert order[least] < min(order[0], order[1]) and base != twin and similarity(base, twin) >= 0.8
    rows = {0: base, 1: twin, 2: strangers[least - 2]}
    keys = [set(vc.class_keys(vc.shingle_hashes(t))) for t in rows.values()]
    assert keys[0] == keys[1] == keys[2] and max(similarity(rows[2], rows[0]), similarity(rows[2], rows[1])) < 0.8
    table = documents(spark, [(i, t, "en") for i, t in rows.items()])
    assert {row["doc_id"] for row in vc.without_similar(table).collect()} == set(staying_by_hand(spark, rows))
    assert len(staying_by_hand(spark, rows)) == 2


def test_rounds_and_pairs_of_the_rest_agree(spark):
    r = rng(55)
    base = prose(r, lines=1, words=220)
    family = [edited(r, base, 0.02) for _ in range(40)]
    rows = dict(enumerate(family + [edited(r, text, 0.005) for text in family]))
    table = documents(spark, [(i, t, "en") for i, t in rows.items()])
    found = [{x.node for x in vc.superfluous_texts(table, rounds=n).collect()} for n in (0, 1, 50)]
    assert found[0] == found[1] == found[2] != set()


def test_rows_under_a_key_meet_each_with_each(spark):
    rows = spark.createDataFrame([(1, 10, 0), (1, 20, -1), (1, 30, -2), (2, 30, -2), (2, 40, 0)], "key long, node long, fingerprint long")
    assert [tuple(p) for p in vc.close_pairs(rows, rows).collect()] == [(30, 20)]

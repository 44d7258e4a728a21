from collections import Counter

from pyspark.sql import functions as F

from inkgrid.llm import leaks
from tests.llm.tables import documents, odd_texts, prose, rng

GOLDENS = "item_id long, text string"


def best_by_hand(text, golden, size=5):
    """Greatest weighted similarity over all windows as long as the golden."""
    words, own = (leaks.WORD.findall((x or "").lower()) for x in (text, golden))
    if not own:
        return 0.0
    size = min(size, len(own))
    b = leaks.shingle_weights(own, size)
    best = 0.0
    for start in range(max(1, len(words) - len(own) + 1)):
        a = leaks.shingle_weights(words[start : start + len(own)], size)
        union = sum((a | b).values())
        best = max(best, sum((a & b).values()) / union)
    return best


def test_finds_what_all_windows_hold(spark):
    r = rng(5)
    goldens = [(i, prose(r, lines=2, words=r.randint(8, 20))) for i in range(12)] + [(50, "only four words here"), (51, "Once"), (52, None), (53, "?!")]
    rows = []
    for i in range(60):
        text = prose(r, lines=3)
        if i % 3 == 0:
            words = goldens[i % 12][1].upper().split()
            if i % 6 == 0:
                words[r.randrange(len(words))] = "changed"
            if i % 9 == 0:
                words = words[: len(words) // 2]
            text = text[: len(text) // 2] + " " + " ".join(words) + " " + text
        rows.append((i, text, "en"))
    rows += [(70, "say only four words here now", "en"), (71, "once", "en"), (72, rows[3][1], "en"), (72, rows[3][1], "en")]
    found = leaks.find_leaks(documents(spark, rows), spark.createDataFrame(goldens, GOLDENS))
    got = Counter((row["doc_id"], row["item_id"]) for row in found.collect())
    want = Counter((i, item) for i, text, _ in rows for item, golden in goldens if best_by_hand(text, golden) >= 0.8)
    assert got == want and got[72, 3] == 2 and got[71, 51] == 1
    for row in found.collect():
        assert row["similarity"] >= 0.8 and row["n_words"] > 0
    clean = leaks.without_leaks(documents(spark, rows), spark.createDataFrame(goldens, GOLDENS))
    assert {row["doc_id"] for row in clean.collect()} == {i for i, *_ in rows} - {i for i, _ in want}


def test_parts_of_a_large_set_agree(spark, monkeypatch):
    r = rng(6)
    goldens = [(i, prose(r, lines=1, words=15)) for i in range(10)]
    table = documents(spark, [(i, prose(r) + "\n" + goldens[i][1], "en") for i in range(10)])
    monkeypatch.setattr(leaks, "PART", 3)
    found = leaks.find_leaks(table, spark.createDataFrame(goldens, GOLDENS)).collect()
    assert {(row["doc_id"], row["item_id"]) for row in found} == {(i, i) for i in range(10)}


def test_all_fingerprints_in_radius_are_near():
    r = rng(8)
    goldens = leaks.Goldens([prose(r, lines=1, words=12) for _ in range(50)], 5)
    for _ in range(200):
        probe = goldens.items[r.randrange(50)][4]
        for bit in r.sample(range(64), r.randint(0, 26)):
            probe ^= 1 << bit
        assert goldens.near(probe) == {i for i, item in enumerate(goldens.items) if (item[4] ^ probe).bit_count() <= leaks.RADIUS}


def test_odd_rows_and_empty_tables(spark):
    odd = documents(spark, [(i, t, None) for i, t in enumerate(odd_texts())] + [(None, None, None)])
    odd = odd.withColumns({"item_id": F.lit("x"), "similarity": F.lit(1)})
    goldens = spark.createDataFrame([(1, "word word word word word word"), (None, "never ever seen here at all"), (3, "")], GOLDENS)
    assert [(row["doc_id"], row["item_id"]) for row in leaks.find_leaks(odd, goldens).collect()] == [(4, 1)]
    assert leaks.without_leaks(odd, goldens).columns == odd.columns
    assert leaks.find_leaks(odd, goldens.limit(0)).count() == 0
    assert leaks.without_leaks(odd, goldens.limit(0)).count() == odd.count()
    assert leaks.find_leaks(documents(spark, []), goldens).count() == 0

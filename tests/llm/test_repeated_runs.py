import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkgrid.llm import repeats
from tests.llm.tables import documents, odd_texts, prose, rng, sentence


def by_hand(rows, min_words=30):
    """(doc_id, text) to text without repeated pairs of lines and long lines."""
    keeper, out = {}, {}
    for doc_id, text in sorted({r for r in rows if r[1] is not None}):
        lines = text.split("\n")
        told = [i for i, line in enumerate(lines) if line.strip(" \t\r\f\v")]
        units = list(zip(told, told[1:])) + [(i, i) for i in told if lines[i].count(" ") >= min_words - 1]
        gone = set()
        for first, last in sorted(units):
            held = (lines[first], lines[last] if first != last else None)
            kept_id, kept_text, kept_last = keeper.setdefault(held, (doc_id, text, last))
            if (kept_id, kept_text, kept_last) != (doc_id, text, last):
                gone |= set(range(max(first, kept_last + 1) if (kept_id, kept_text) == (doc_id, text) else first, last + 1))
        out[doc_id, text] = ("\n".join(line for i, line in enumerate(lines) if i not in gone), len(gone))
    return out


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_planted_runs_vanish_whole(spark, n):
    r = rng(100 + n)
    runs = [[sentence(r, words=-(-51 // n) + r.randint(0, 1)) for _ in range(n)] for _ in range(12)]
    assert all(len(" ".join(run).split()) > 50 and max(line.count(" ") for line in run) < 29 for run in runs)
    rows, rest = [], {}
    for i in range(48):
        own = [sentence(r, words=r.randint(3, 12)) for _ in range(r.randint(0, 5))]
        at = r.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + runs[i % 12] + own[at:])))
        rest[i] = "\n".join(own)
    got = {row["doc_id"]: row for row in repeats.drop_repeated_runs(documents(spark, [(i, t, "en") for i, t in rows])).collect()}
    for i, text in rows:
        if i < 12:
            assert (got[i]["text"], got[i]["removed_lines"]) == (text, 0)
        else:
            assert (got[i]["text"], got[i]["removed_lines"]) == (rest[i], n)


def test_equals_brute_force(spark):
    r = rng(5)
    pool = [sentence(r, words=r.choice([1, 5, 40])) for _ in range(14)] + ["", " "]
    rows = [(r.randint(0, 60), "\n".join(r.choices(pool, k=r.randint(1, 12)))) for _ in range(80)]
    rows += [rows[0], (200, rows[0][1]), (201, "a b\na b\na b"), (202, "x\n\ny"), (203, "x\ny"), (204, "z\nx\n \n\ny\nz")]
    got = repeats.drop_repeated_runs(documents(spark, [(i, t, "en") for i, t in rows])).collect()
    want = by_hand(rows)
    assert sorted((row["doc_id"], row["text"], row["removed_lines"]) for row in got) == sorted((i, *want[i, t]) for i, t in rows)
    texts = {row["doc_id"]: row["text"] for row in got}
    assert (texts[201], texts[203], texts[204]) == ("a b\na b", "", "z\nz")
    # whatever goes stays in one place
    assert {line for _, t in rows for line in t.split("\n") if line.strip()} <= {line for row in got for line in row["text"].split("\n")}


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    rows = [(i, t, None) for i, t in enumerate(odd_texts())] + [(None, "a b\nc", "en"), (None, None, None)]
    table = documents(spark, rows).withColumns({"removed_lines": F.lit("x"), "KEY_id": F.lit(1), "spans": F.lit(2), "last": F.lit(3)})
    out = repeats.drop_repeated_runs(table)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "KEY_id", "spans", "last", "removed_lines"]
    got = {(row["doc_id"], row["text"]): row["removed_lines"] for row in out.collect()}
    assert len(got) == len(rows) and set(got.values()) == {0}
    assert repeats.drop_repeated_runs(documents(spark, [])).count() == 0
    assert "Python" not in repeats.drop_repeated_runs(documents(spark, [(1, prose(rng()), "en")]))._jdf.queryExecution().toString()


@pytest.mark.parametrize(("window", "divisor"), [(1, 1), (2, 2), (3, 1_000)])
def test_chunks_come_first_and_pairs_find_the_rest(spark, monkeypatch, window, divisor):
    r = rng(6)
    pool = [sentence(r, words=r.choice([1, 5, 40])) for _ in range(30)] + ["", "x", "x"]
    rows = [(i, "\n".join(r.choices(pool, k=4) + pool[5:13] + r.choices(pool, k=4))) for i in range(30)]
    found, chunks_of = [], repeats.surplus_chunks

    def spied(*args):
        found.append(chunks_of(*args))
        return found[-1]

    monkeypatch.setattr(repeats, "surplus_chunks", spied)
    out = repeats.drop_repeated_runs(documents(spark, [(i, t, "en") for i, t in rows]), window=window, divisor=divisor)
    want = by_hand(rows)
    assert {(row["doc_id"], row["text"], row["removed_lines"]) for row in out.collect()} == {(i, *want[i, t]) for i, t in rows}
    texts = dict(rows)
    chunks = [(c["id"], "\n".join(texts[c["id"]].split("\n")[c["first"] : c["last"] + 1])) for c in found[0].collect()]
    # each chunk that goes is held by an earlier or the same text
    assert len(chunks) >= 29 and all(any(j <= i and c in texts[j] for j in texts) for i, c in chunks)
    assert min(i for i, _ in chunks) <= 1


def test_lines_of_equal_hash_are_no_copies(spark):
    r = rng(8)
    run = prose(r, lines=6)
    table = documents(spark, [(i, run, "en") for i in range(2)]).select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"), repeats.hashed_lines(F.col("text"), 30).alias("h")
    ).select("id", "print", "h.*")
    none = spark.createDataFrame([], "hash long")
    assert {row["id"] for row in repeats.surplus_chunks(table, none, 2, 2).collect()} <= {1}
    every = table.select(F.explode("hashes").alias("hash")).distinct()
    assert repeats.surplus_chunks(table, every, 2, 2).count() == 0


def test_line_stage_of_the_pipeline_leaves_nothing_of_a_copy(spark):
    r = rng(41)
    texts = [prose(r, lines=7) for _ in range(8)]
    docs = documents(spark, [(i, text, "en") for i, text in enumerate(texts + texts)])
    assert sorted(row["doc_id"] for row in corpus_pipeline.line_stage(spark, docs, "").collect()) == list(range(8))

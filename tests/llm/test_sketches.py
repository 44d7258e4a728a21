from pyspark.sql import functions as F

from inkgrid.llm import queries, sketches
from tests.llm.tables import documents, odd_texts, prose, rng


def paragraphs(text):
    return {line for line in (text or "").split("\n") if line.strip(" ")}


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_of_versions_is_exact(spark):
    r = rng(12)
    rows = []
    for i in range(30):
        lines = prose(r, lines=r.choice([1, 3, 12, 60, 300]), words=4).split("\n")
        edited = [line if r.random() < 0.7 else line + "!" for line in lines] + ["new"] * (i % 3)
        rows.append((i, "\n".join(lines), "\n".join(edited), "\n".join(reversed(lines))))
    rows += [(100 + i, t, rows[0][1], t) for i, t in enumerate(odd_texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, edited string, other string")
    frame = frame.withColumns({"_d0": F.lit(1), "fingerprint": F.lit("old")})
    got = sketches.fingerprint_versions(frame, ["edited", "other"])
    assert got.columns == [*frame.columns, "edited_fingerprint", "edited_likeness", "other_fingerprint", "other_likeness"]
    for row in got.collect():
        assert abs(row["edited_likeness"] - jaccard(row["text"], row["edited"])) < 1e-12
        assert row["other_likeness"] == 1.0 and row["other_fingerprint"] == row["fingerprint"]
        assert (row["fingerprint"] == row["edited_fingerprint"]) == (paragraphs(row["text"]) == paragraphs(row["edited"]))
        assert len(row["fingerprint"]) == 28 * sketches.ROWS * sketches.WIDTH


def test_small_tables_recover_digests_and_overfull_ones_say_so(spark):
    frame = spark.range(200).select(
        F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.xxhash64("id", i)).alias("a"),
        F.transform(F.sequence(F.lit(4), F.lit(8)), lambda i: F.xxhash64("id", i)).alias("b"),
        F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64("id", i)).alias("many"),
    )
    t = {c: sketches.table_of(F.col(c)) for c in frame.columns}
    out = frame.select("a", "b", sketches.peeled(sketches.subtracted(t["a"], t["b"])).alias("d"), sketches.peeled(t["many"]).alias("n")).collect()
    whole = [row for row in out if row["d"] is not None]
    assert len(whole) > 150 and all(row["n"] is None for row in out)
    for row in whole:
        assert {(x["digest"], x["n"]) for x in row["d"]} == {(x, 1) for x in set(row["a"]) - set(row["b"])} | {(x, -1) for x in set(row["b"]) - set(row["a"])}


def test_following_text_over_runs_gaps_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(sketches, "RUN", 4)
    ids = [0, 1, 2, 5, 6, 6, 30, 31, 32, 33, 34, 90, None]
    rows = [(i, f"t{n}" if i != 6 else "same", "en") for n, i in enumerate(ids)]
    got = sketches.with_following(documents(spark, rows)).collect()
    order = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0))
    want = sorted(str((a[0], a[1], b[1])) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted(str(tuple(row)) for row in got) == want
    assert sketches.with_following(documents(spark, [])).count() == 0
    assert sketches.with_following(documents(spark, [(7, "alone", "en")])).first()["following"] == "alone"


def test_query_equals_contract(spark, tmp_path):
    import hashlib

    r = rng(13)
    rows = [(3 * i, prose(r, lines=1 + i % 5), "en") for i in range(12)] + [(100, None, "en"), (101, "odd", "en"), (102, "é\nü", "de")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {row["doc_id"]: row for row in queries.op5_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for at, (doc_id, text, _) in enumerate(rows):
        text, after = text or "", rows[(at + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[doc_id]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(row["near_edited"] - jaccard(text, edited)) < 1e-12 and abs(row["near_next"] - jaccard(text, after)) < 1e-12


def test_no_python_in_the_plan(spark, tmp_path):
    documents(spark, [(1, "a", "en")]).write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op5_fingerprints(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan

import hashlib

import pytest
from pyspark.sql import functions as F

from inkgrid.llm import infill, queries
from inkgrid.llm.texts import document_texts
from tests.llm.tables import documents, odd_texts, prose, rng


def by_hand(doc_id, text, units):
    """The contract word by word: units are given as a list that joins to the text."""
    digits = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 3, 64, 1024])
def test_cuts_equal_a_walk(block):
    r = rng(31)
    for n in (0, 1, 2, 63, 64, 65, 500):
        text = "".join(r.choices("aé日🙂\n ", k=n))
        points, lines = infill.CutTree(text, block=block), infill.CutTree(text, infill.LINES, block)
        cut_lines = text.splitlines(keepends=True)
        assert (points.n, lines.n) == (n, len(cut_lines))
        for k in range(n + 1):
            assert points.cut(k) == (len(text[:k].encode()), k)
        for k in range(lines.n + 1):
            before = "".join(cut_lines[:k])
            assert lines.cut(k) == (len(before.encode()), len(before))


def test_equals_brute_force_and_goes_back(spark):
    r = rng(32)
    texts = [prose(r, lang) for lang in ("en", "de") * 40] + odd_texts()
    texts += ["has <M> inside", "<P", "S>", "<", "ends with <S", "𝄞" * 3_000, texts[0]]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    table = documents(spark, rows).withColumns({"form": F.lit("old"), "INFILL": F.lit(1)})
    out = infill.fill_in_middle(table).withColumn("back", infill.restored(F.col("infill"), F.col("form")))
    got = {row["doc_id"]: row for row in out.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        row, text = got[i], text or ""
        assert tuple(row[c] for c in ("n_units", "form", "prefix_chars", "middle_chars", "infill")) == by_hand(i, text, text)
        assert row["back"] == text
    assert {row["form"] for row in got.values()} == {"plain", "psm", "spm"}


def test_query_equals_contract(spark, tmp_path):
    r = rng(33)
    rows = [(i, prose(r), "en") for i in range(30)] + [(30, None, None), (None, "no id", None), (30, "again", None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_fill_in_middle(spark, str(tmp_path))
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
        "output_sha256": "string", "restored_sha256": "string",
    }
    expected = []
    for i, text, _ in rows:
        *front, output = by_hand("" if i is None else i, text or "", text or "")
        expected.append((i, *front, *(hashlib.sha256(t.encode()).hexdigest() for t in (output, text or ""))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_lines_of_transcribed_pages(spark):
    words = spark.createDataFrame(
        [("card", 1, 0, "Entrada", 0.0, 9.0, 10.0, 18.0), ("card", 1, 1, "Saída", 0.0, 9.0, 30.0, 38.0),
         ("card", 2, 0, "08:00", 0.0, 9.0, 10.0, 18.0)],
        "doc_id string, page int, word_seq int, text string, x0 double, x1 double, top double, bottom double",
    )
    texts = document_texts(words)
    assert texts.first()["text"] == "Entrada\nSaída\n08:00"
    row = infill.fill_in_middle(texts, infill.LINES, plain_percent=0).first()
    assert row["n_units"] == 3
    text = texts.first()["text"]
    assert (row["n_units"], row["form"], row["prefix_chars"], row["middle_chars"], row["infill"]) == by_hand(
        "card", text, text.splitlines(keepends=True)
    )
    assert infill.fill_in_middle(texts.limit(0)).count() == 0

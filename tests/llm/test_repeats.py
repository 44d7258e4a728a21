import xxhash
from pyspark.sql import functions as F

from inkgrid.llm import repeats
from tests.llm.tables import documents, odd_texts, prose, rng, sentence


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def hash_longs(values):
    """Hash of an array of longs: each value with the hash so far as seed."""
    out = 42
    for value in values:
        out = xxhash.xxh64_intdigest((value & ((1 << 64) - 1)).to_bytes(8, "little"), out)
    return signed(out)


def chunks(text, window=2, divisor=2, min_words=30):
    lines = text.split("\n")
    hashes = [signed(xxhash.xxh64_intdigest(line.encode(), 42)) for line in lines]
    long = [line.count(" ") >= min_words - 1 for line in lines]
    found, first = [], 0
    for i in range(len(lines)):
        last = i == len(lines) - 1
        rolling = hash_longs(hashes[max(0, i - window + 1) : i + 1])
        if last or long[i] or long[i + 1] or rolling % divisor == 0:
            n = i - first + 1
            if n > 1 or long[first]:
                found.append((first, n, "\n".join(lines[first : first + n])))
            first = i + 1
    return found


def by_hand(rows):
    """(doc_id, text) to text without repeated chunks."""
    keeper, out = {}, {}
    for doc_id, text in sorted({r for r in rows if r[1] is not None}):
        lines = text.split("\n")
        gone = set()
        for first, n, chunk in chunks(text):
            if chunk in keeper:
                gone |= set(range(first, first + n))
            keeper.setdefault(chunk, doc_id)
        out[doc_id, text] = ("\n".join(line for i, line in enumerate(lines) if i not in gone), len(gone))
    return out


def test_equals_brute_force_on_shifted_passages(spark):
    r = rng(3)
    passage = [sentence(r, words=8) for _ in range(9)]
    paragraph = sentence(r, words=55)
    rows = []
    for i in range(40):
        lines = [sentence(r, words=9) for _ in range(r.randint(2, 6))]
        if i % 3 == 0:
            lines[r.randint(0, 2) : 0] = passage
        if i % 4 == 0:
            lines.insert(r.randint(0, 2), paragraph)
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (5, rows[5][1]), (102, "")]
    got = repeats.drop_repeated_chunks(documents(spark, [(i, t, "en") for i, t in rows])).collect()
    want = by_hand(rows)
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for row in got:
        assert (row["text"], row["removed_lines"]) == want[row["doc_id"], texts[row["doc_id"]]]
    held = [row for row in got if paragraph in row["text"]]
    assert [row["doc_id"] for row in held] == [0]
    assert sum("\n".join(passage) in row["text"] for row in got) == 1
    # what is not repeated stays
    assert all(row["removed_lines"] == 0 for row in got if row["doc_id"] < 100 and row["doc_id"] % 3 and row["doc_id"] % 4)


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    rows = [(i, t, None) for i, t in enumerate(odd_texts())] + [(None, "a b\nc", "en"), (None, None, None)]
    table = documents(spark, rows).withColumns({"removed_lines": F.lit("x"), "KEY_id": F.lit(1), "spans": F.lit(2), "digest": F.lit(3)})
    out = repeats.drop_repeated_chunks(table)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "KEY_id", "spans", "digest", "removed_lines"]
    got = {(row["doc_id"], row["text"]): row["removed_lines"] for row in out.collect()}
    assert len(got) == len(rows) and set(got.values()) == {0}
    assert repeats.drop_repeated_chunks(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = repeats.drop_repeated_chunks(documents(spark, [(1, prose(rng()), "en")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from inkgrid.llm import language, tokens
from tests.llm.tables import documents, prose, rng, sentence
from tests.llm.test_leaks import best_by_hand
from tests.llm.test_repeated_runs import by_hand
from tests.llm.test_verified_copies import staying_by_hand


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = rng(20)
    folder = str(tmp_path_factory.mktemp("tables"))
    goldens = [(i, prose(r, lines=1, words=25)) for i in range(5)]
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = prose(r, lang, lines=6)
        if i % 10 == 4:
            text += "\n" + goldens[i % 5][1]
        if i % 12 == 5:
            words = rows[i - 3][1].split(" ")
            words[7] = "changed"
            text = " ".join(words)
        if i % 15 == 7:
            text += "\n" + sentence(rng(1), words=60)
        rows.append((i, text, lang))
    rows += [(100, None, None), (101, "", "en"), (102, "12 34", "en"), (103, rows[0][1], "de"), (104, "short", None)]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(goldens, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, goldens


def test_stages_equal_brute_force(spark, tables):
    folder, rows, goldens = tables
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
    table = spark.read.parquet(f"{folder}/documents.parquet")
    trees = language.fit_trees(table.select("lang", "text"))
    texts = {}
    for i, text, _ in rows:
        if text and any(map(str.isalpha, text)):
            bits, sizes = trees.code_lengths([text])
            if bits.min() < 8 * sizes[0]:
                texts[i] = text
    assert set(texts) == {i for i, *_ in rows} - {100, 101, 102}
    cleaned = {i: out for (i, _), out in by_hand(list(texts.items())).items()}
    texts = {i: text for i, (text, gone) in cleaned.items() if not gone or text.strip(" ")}
    texts = staying_by_hand(spark, texts)
    texts = {i: t for i, t in texts.items() if all(best_by_hand(t, g) < 0.8 for _, g in goldens)}
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {row["doc_id"]: row for row in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(texts) and 20 < len(got) < 60
    for i, row in got.items():
        assert row["text"] == texts[i] and row["token_ids"] == known.encode_ordinary(texts[i]) and row["n_tokens"] == len(row["token_ids"])


def test_stages_return_the_columns_of_documents(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes and out.count() == 0

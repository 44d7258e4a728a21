import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkgrid.llm import language
from tests.llm.tables import documents, odd_texts, prose, rng

ORDER = 2


def by_hand(counts, text, order=ORDER):
    """Bits of a text from nested dictionaries of counts, byte by byte."""
    raw = language.START * order + text.lower().encode()
    bits = 0.0
    for at in range(order, len(raw)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8.0
                break
            seen = counts.get(raw[at - k : at], {})
            total = sum(seen.values())
            if raw[at] in seen:
                bits -= np.log2(seen[raw[at]] / (total + len(seen)))
                break
            if seen:
                bits -= np.log2(len(seen) / (total + len(seen)))
    return bits


def counted(texts, order=ORDER):
    counts = {}
    for text in texts:
        raw = language.START * order + text.lower().encode()
        for at in range(order, len(raw)):
            for k in range(order + 1):
                seen = counts.setdefault(raw[at - k : at], {})
                seen[raw[at]] = seen.get(raw[at], 0) + 1
    return counts


def test_prices_equal_those_by_hand(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 50)
    r = rng()
    texts = {lang: [prose(r, lang) for _ in range(4)] for lang in ("en", "de")}
    rows = [(i, t, lang) for lang in texts for i, t in enumerate(texts[lang])]
    trees = language.fit_trees(documents(spark, rows), order=ORDER)
    assert trees.languages == ["de", "en"]
    for text in (prose(r, "en"), prose(r, "de"), "Zzz 99 §", "", texts["en"][0] * 3):
        bits, sizes = trees.code_lengths(["abc", text])
        assert np.allclose(bits[1], [by_hand(counted(texts[lang]), text) for lang in ("de", "en")])
        assert sizes[1] == len(text.lower().encode())


def test_held_out_texts_are_told_apart(spark):
    r = rng(1)
    rows = [(i, prose(r, lang), lang) for i, lang in enumerate(["en", "de"] * 40)]
    table = documents(spark, rows)
    trees = language.fit_trees(table.filter("doc_id < 60"))
    judged = language.identify_languages(spark, table.filter("doc_id >= 60"), trees)
    assert judged.filter("lang <> lang_pred or score < 0.9 or score > 1").count() == 0
    assert judged.filter(language.recognised()).count() == 20


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    r = rng(2)
    rows = [(i, prose(r, lang), lang) for i, lang in enumerate(["en", "de"] * 5)]
    trees = language.fit_trees(documents(spark, [*rows, (90, None, "en"), (91, "the", None), (92, "77", "en")]))
    odd = odd_texts()
    table = documents(spark, [(i, t, None) for i, t in enumerate([*odd, *odd])]).withColumns({"score": F.lit("old"), "Bits": F.lit(1)})
    out = language.identify_languages(spark, table, trees).toPandas()
    assert list(out.columns[:5]) == ["doc_id", "text", "lang", "source", "n_chars"] and "Bits" in out
    assert out["score"].between(0, 1).all()
    for row in out.itertuples():
        letters = row.text is not None and any(map(str.isalpha, row.text))
        assert (row.lang_pred == "und") == (not letters)
    half = len(odd)
    assert out["lang_pred"][:half].tolist() == out["lang_pred"][half:].tolist()
    nothing = documents(spark, [])
    assert language.fit_trees(nothing) is None
    assert language.identify_languages(spark, nothing, trees).count() == 0
    assert language.identify_languages(spark, table, None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_equal_codes_go_to_the_first_language():
    counts = pd.DataFrame({"lang": ["b", "a"], "k": 0, "gram": 97, "n": 1})
    trees = language.ContextTrees(["a", "b"], counts, 0)
    assert trees.code_lengths(["aaa"])[0].argmin(axis=1)[0] == 0

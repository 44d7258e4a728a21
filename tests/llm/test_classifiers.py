import numpy as np
from pyspark.sql import functions as F

from inkgrid.llm import quality, queries, severity
from inkgrid.llm.features import SparseRows, hashed_words
from tests.llm.tables import documents, odd_texts, prose, rng

LABELS = "doc_id long, quality int, toxic int"


def damaged(r, text):
    return " ".join(word + r.choice(["***", "$$$", "###"]) for word in text.split())


def labelled(spark, n=400):
    r = rng(16)
    rows, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.3
        text = prose(r, lines=3)
        if toxic:
            text += " " + " ".join(r.choices(["vileword", "foulword"], k=r.choice([1, 1, 6])))
        rows.append((i, text if good else damaged(r, text), "en"))
        labels.append((i, int(good), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_quality_and_toxicity_on_rows_not_learned_from(spark):
    texts, labels = labelled(spark)
    seen = labels.filter("doc_id % 2 = 0")
    scored = quality.score_quality(texts, quality.fit_quality(texts, seen)).join(labels, "doc_id").filter("doc_id % 2 = 1")
    assert scored.filter("keep <> (quality = 1)").count() <= 2
    model = severity.fit_severity(texts, seen.select("doc_id", (F.col("toxic") > 0).alias("severe")))
    out = severity.score_severity(texts, model).join(labels, "doc_id").filter("doc_id % 2 = 1").toPandas()
    assert (out["severe"] == (out["toxic"] == 1)).mean() > 0.97
    often = out["text"].str.count("vileword|foulword")
    assert out[often >= 5]["expected_severity"].mean() > out[(often > 0) & (often < 5)]["expected_severity"].mean() > 0.5
    assert (np.diff(model.thresholds) > 0).all()


def test_views_teach_each_other():
    """With a few labelled rows the pool brings the weak view near the strong one."""
    r = np.random.default_rng(1)
    y = np.repeat([0.0, 1.0], 2000)
    strong, weak = y[:, None] * 4 + r.normal(size=(4000, 1)), y[:, None] + r.normal(size=(4000, 3))
    order = r.permutation(4000)
    few, pool = order[:60], order[60:]
    model = quality.co_train((strong[few], weak[few]), y[few], (strong[pool], weak[pool]), np.arange(60) % 3 == 0, rounds=8, share=0.1)
    alone = quality.fit_logistic(weak[few], y[few])
    right = lambda p: ((p > 0) == (y == 1)).mean()
    assert right(quality.logits(weak, model.metadata)) >= right(quality.logits(weak, alone)) - 0.01
    assert right(model.score(strong, weak) - 0.5) > 0.95


def test_ordinal_gradient_finds_ordered_grades():
    r = rng(17)
    texts, grades = [], []
    for _ in range(600):
        grade = r.choice([0, 1, 2, 3])
        texts.append(prose(r, lines=1) + " bad" * (grade > 0) + " worse" * (grade > 1) + " worst" * (grade > 2))
        grades.append(grade)
    rows = SparseRows.of([hashed_words(t, severity.DIMS) for t in texts])
    model = severity.fit_ordinal(rows, np.array(grades))
    expected = model.over(texts).sum(axis=1)
    assert abs(expected - grades).mean() < 0.35
    means = [expected[np.array(grades) == g].mean() for g in range(4)]
    assert means == sorted(means)


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    texts, labels = labelled(spark, 120)
    odd = documents(spark, [(i, t, None) for i, t in enumerate([*odd_texts(), *odd_texts()])] + [(None, None, None)])
    odd = odd.withColumns({"keep": F.lit("old"), "severe": F.lit("old"), "Quality": F.lit(1)})
    good = quality.score_quality(odd, quality.fit_quality(texts, labels)).toPandas()
    assert good["quality_score"].between(0, 1).all() and good["keep"].dtype == bool
    bad = severity.score_severity(odd, severity.fit_severity(texts, labels.withColumn("severe", F.col("toxic") > 0))).toPandas()
    assert bad["expected_severity"].between(0, 2).all() and not bad["severe"].any()
    n = len(odd_texts())
    for out, column in ((good, "quality_score"), (bad, "expected_severity")):
        assert out[column][:n].tolist() == out[column][n : 2 * n].tolist()
    nothing, none = documents(spark, []), labels.limit(0)
    assert quality.fit_quality(nothing, labels) is quality.fit_quality(texts, none) is None
    assert severity.fit_severity(nothing, labels.withColumnRenamed("toxic", "grade")) is None
    assert quality.score_quality(odd, None).filter("keep").count() == severity.score_severity(odd, None).count() == odd.count()
    assert quality.score_quality(nothing, None).count() == severity.score_severity(nothing, None).count() == 0


def test_queries_give_every_document(spark, tmp_path):
    texts, labels = labelled(spark, 150)
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.op6_quality(spark, str(tmp_path)).select("doc_id").distinct().count() == 150
    assert queries.op10_toxicity(spark, str(tmp_path)).select("doc_id").distinct().count() == 150

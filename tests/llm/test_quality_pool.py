import numpy as np
from pyspark.sql import functions as F

from inkgrid.llm import quality
from tests.llm.test_classifiers import labelled


def test_the_whole_unlabelled_corpus_takes_part(spark):
    texts, labels = labelled(spark, 200)
    many = texts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(89)))).filter("doc_id >= 100 or copy = 0")
    many = many.withColumn("text", F.when(F.col("copy") == 0, F.col("text")).otherwise(F.concat("text", F.lit(" "), F.col("copy").cast("string"))))
    known = texts.join(labels.filter("doc_id < 100"), "doc_id")
    pool = quality.pool_of(many.drop("copy"), known)
    assert pool.count() == 100 * 90  # none of the labelled
    assert quality.pool_of(many.drop("copy").unionByName(known.select(*texts.columns).withColumn("doc_id", F.lit(999))), known).count() == 9000
    weights = (np.zeros(71), np.zeros(129))
    assert quality.spark_pool(pool)(quality.counted, [], weights)[-1] == 9000


def test_pool_on_spark_equals_the_pool_in_memory(spark):
    texts, labels = labelled(spark, 300)
    known = quality.views_of(texts.join(labels.filter("doc_id < 100").selectExpr("doc_id", "quality as mark"), "doc_id").orderBy("doc_id"))
    content, metadata = (np.vstack(known[c]) for c in ("content", "metadata"))
    y, check = known["mark"].to_numpy(dtype=float), np.arange(len(known)) % 4 == 3
    pool = quality.pool_of(texts, texts.filter("doc_id < 100"))
    rows = pool.toPandas()
    views, ties = quality.unpacked(rows), rows["tie"].to_numpy()
    assert len(rows) == 200
    memory = quality.co_train((content, metadata), y, lambda sums, past, w: sums(views, ties, past, w), check, share=0.2)
    spread = quality.co_train((content, metadata), y, quality.spark_pool(pool.repartition(3)), check, share=0.2)
    assert np.allclose(memory.content, spread.content, atol=1e-3) and np.allclose(memory.metadata, spread.metadata, atol=1e-3)


def test_quota_is_a_quantile_of_all_rows():
    counts = np.zeros(8001)
    counts[7000], counts[6000], counts[5000] = 3, 10, 5
    assert quality.surest(counts, 3, 4295) == (6000, 0.0)
    assert quality.surest(counts, 8, 4295) == (6000, 0.5)
    assert quality.surest(counts, 100, 4295) == (4294, 0.0)
    assert quality.surest(counts, 15, 5500) == (5499, 0.0)

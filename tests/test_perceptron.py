"""The perceptron on sparse rows against MLlib's own trainer and finite differences."""

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from flowguard.operators import perceptron, webshell

LAYERS = [6, 3, 2, 2]


def test_gradient_equals_finite_differences():
    random = np.random.default_rng(3)
    weights = random.normal(size=6 * 3 + 3 + 3 * 2 + 2 + 2 * 2 + 2)
    row, place = np.array([0, 0, 2, 3]), np.array([1, 5, 0, 5])  # row 1 is empty
    value, label = random.normal(size=4), np.array([0, 1, 1, 0])
    _, got = perceptron.loss_and_gradient(weights, LAYERS, row, place, value, label)
    for k in range(len(weights)):
        more, less = weights.copy(), weights.copy()
        more[k] += 1e-5
        less[k] -= 1e-5
        up, down = (perceptron.loss_and_gradient(w, LAYERS, row, place, value, label)[0] for w in (more, less))
        assert abs((up - down) / 2e-5 - got[k]) < 1e-6


def test_scores_as_mllib_and_no_dense_rows_are_kept(spark, tmp_path):
    rows = [(f"{'bad' if k % 3 == 0 else 'good'} word{k % 7} word{k % 5}", float(k % 3 == 0)) for k in range(90)]
    df = spark.createDataFrame(rows, "payload string, label double").repartition(3)
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    fitted = webshell.train(df, buckets=256, rounds=30)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == kept
    fitted.write().overwrite().save(str(tmp_path / "model"))
    scored = fitted.transform(df)
    assert scored.where(F.col("label") != F.col("prediction")).count() == 0
    prepared = webshell.text_pipeline(256).fit(df).transform(df)
    mllib = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="label", layers=[256, 5, 2, 2], maxIter=0, seed=1).fit(prepared)
    start = mllib.weights.toArray()
    own = perceptron.fit(prepared, "_x", [256, 5, 2, 2], 0, 1)
    assert np.array_equal(own.weights.toArray(), start)
    p = [r.probability[int(r.label)] for r in mllib.transform(prepared).select("probability", "label").collect()]
    want = -np.mean(np.log(p))
    path = str(tmp_path / "rows")
    prepared.select(F.col("_x").alias("x"), "label").write.parquet(path)
    got, _ = perceptron.summed(spark.read.schema(perceptron.SPARSE).parquet(path), [256, 5, 2, 2], start)
    assert abs(got - want) < 1e-9


def test_linear_hits_equal_linear_classes_without_a_window(spark):
    texts = [f"{'aa ' * (k % 4)}{'bb ' * (k % 3)}cc{k % 5} dd" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "pkt_no int, payload string")
    counts = webshell.term_counts(df)
    idf = webshell.fit_idf(counts, df.agg(F.count("*")))
    terms = {"aa": 3.0, "bb": -2.5}
    want = webshell.linear_classes(webshell.tfidf(counts, idf), terms, -1.0).where("prediction = 1")
    hits = webshell.linear_hits(counts, idf, terms, -1.0)
    found = sorted(r.pkt_no for r in hits.collect())
    assert 0 < len(found) < 60 and found == sorted(r.pkt_no for r in want.collect())
    assert "Window" not in hits._jdf.queryExecution().optimizedPlan().toString()

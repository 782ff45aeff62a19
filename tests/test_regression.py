"""The fit of many rows: what its steps send the driver, and its optimum."""

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tonecast.operators import classifier, regression

WORDS = [f"{a}{b}" for a in ("alpha", "bravo", "delta", "gamma") for b in ("one", "two", "six", "ten")]


def sent_bytes(monkeypatch) -> list[int]:
    """Bytes of arrays in every list that the driver collects from now on."""
    found, kept = [], RDD.collect

    def collect(self):
        out = kept(self)
        found.append(sum(v.nbytes for _, v in out))
        return out
    monkeypatch.setattr(RDD, "collect", collect)
    return found


@pytest.mark.parametrize("kinds", [2, 3])
@pytest.mark.parametrize("tasks", [1, 6])
def test_fit_reaches_the_optimum_and_sends_one_sum_a_step(spark, monkeypatch, kinds, tasks):
    rng = np.random.default_rng(kinds)
    size, total, penalty = 40, 300, 1 / 600
    x = rng.random((total, size)) * (rng.random((total, size)) < 0.2)
    x[7] = 0
    y = np.argmax(x[:, :kinds] + 0.2 * rng.random((total, kinds)), axis=1)
    y[:kinds] = range(kinds)
    w = 0.5 + rng.random(total)
    rows = spark.createDataFrame([(Vectors.sparse(size, {int(i): float(r[i]) for i in np.flatnonzero(r)}), float(c), float(s))
                                  for r, c, s in zip(x, y, w)], ["features", "_y", "_w"]).cache()
    plain = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", family="multinomial", standardization=False,
                               regParam=penalty, maxIter=2000, tol=1e-12).fit(rows)
    monkeypatch.setattr(regression, "_TASK_ROWS", total // tasks)
    monkeypatch.setattr(regression, "_BLOCK", 100)
    found = sent_bytes(monkeypatch)
    model, steps = regression.fit(rows, kinds, size, total, penalty, 2000, 1e-9)
    assert 0 < steps <= len(found) < 200
    assert max(found) <= 4 * (kinds - 1) * size + 8 * (kinds + 1)
    want, got = plain.coefficientMatrix.toArray(), model.coefficientMatrix.toArray()
    assert np.abs(want - got).max() < 2e-3 * np.abs(want).max()

    W, b = got, model.interceptVector.toArray()
    z = x @ W.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gradient = penalty * W + (w[:, None] * (p - np.eye(kinds)[y])).T @ x / w.sum()
    assert np.abs(gradient).max() < 2e-3 * penalty * np.abs(W).max()


def test_steps_end_at_the_limit(spark):
    rows = spark.createDataFrame([(Vectors.sparse(2, [0, 1], [float(i % 7), 1.0 - i % 3]), float(i % 2), 1.0) for i in range(60)], ["features", "_y", "_w"])
    assert regression.fit(rows, 2, 2, 60, 1e-4, 3, 0.0)[1] == 3


def test_models_of_many_rows_predict_as_others_do(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        s = ("Positive", "Positive", "Negative", "Neutral")[i % 4]
        words = [WORDS[k] for k in rng.integers(0, 16, 6)] + [{"Positive": "lovely", "Negative": "dirty", "Neutral": "plain"}[s]]
        rows.append((f"{i}", " ".join(words) if i else None, "Safety", s))
    df = spark.createDataFrame(rows, "review_id string, review_text string, aspect string, sentiment string")
    plain = classifier.SentimentModel.fit(df)
    monkeypatch.setattr(classifier, "_MANY_ROWS", 100)
    found = sent_bytes(monkeypatch)
    model = classifier.SentimentModel.fit(df)
    assert model.steps <= len(found) and max(found) <= 8 * len(model.features.idf) + 100
    path = str(tmp_path / "model")
    model.save(path)
    columns = ["review_id", "sentiment_pred", "sentiment_confidence"]
    scored = model.transform(df).select(columns)
    assert sorted(scored.collect()) == sorted(classifier.SentimentModel.load(path).transform(df).select(columns).collect())
    both = scored.join(plain.transform(df).select("review_id", F.col("sentiment_pred").alias("p"), F.col("sentiment_confidence").alias("c")), "review_id")
    assert both.filter("sentiment_pred != p").count() == 0
    assert both.agg(F.max(F.abs(F.col("sentiment_confidence") - F.col("c")))).first()[0] < 0.01

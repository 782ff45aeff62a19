import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.views import Views
from tonecast.functions import tokens as tk
from tonecast.operators import attribution, classifier, cleaning, evaluation, features, oversampling, splits, thresholds, topics
from tonecast.plans import jobs
from tonecast.schema import SENTIMENTS

WORDS = {"Positive": "great lovely smooth quick", "Negative": "awful dirty broken late", "Neutral": "average plain usual normal"}


@pytest.fixture(scope="module")
def reviews(spark):
    """Separable texts of three unbalanced classes with shared filler words."""
    sizes = {"Positive": 240, "Negative": 60, "Neutral": 40}
    rows = []
    for s, n in sizes.items():
        good = WORDS[s].split()
        for i in range(n):
            text = f"{good[i % 4]} train ride {good[(i // 4) % 4]} number{i % 9} station{i}"
            rows.append((f"{s}-{i}", text, 3, cleaning.tx.MERGED_ASPECTS[i % 10], s))
    return spark.createDataFrame(rows, "review_id string, review_text string, review_rating int, aspect string, sentiment string").cache()


@pytest.fixture(scope="module")
def model(reviews):
    train = splits.with_split(cleaning.prepare_cleaned(reviews)).filter("split = 'train'")
    return classifier.SentimentModel.fit(train, max_iter=60)


def test_words(spark):
    df = spark.createDataFrame([("The café isn't far: see https://a.b/clean?x=1 www.x.yz trains_run BIG9 dog ab",)], "t string")
    assert df.select(tk.words(F.col("t"), "plain")).first()[0] == ["isn", "far", "see", "https", "clean", "www", "dog"]
    assert df.select(tk.words(F.col("t"), "voice")).first()[0] == ["isn", "far", "dog"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(tk.ngrams(F.col("w"), 2)).collect()]
    assert got == [["a b", "b c"], [], []]
    assert [r[0] for r in df.select(tk.ngrams(F.col("w"), 3)).collect()] == [["a b c"], [], []]


def test_features_have_unit_length(reviews):
    fitted = features.TfIdf.fit(reviews, "review_text")
    lengths = fitted.transform(reviews, "review_text").select(F.sqrt(F.aggregate(
        features.entries(F.col("features")), F.lit(0.0), lambda a, e: a + e["value"] * e["value"]))).collect()
    assert all(r[0] == pytest.approx(1.0) for r in lengths)
    with pytest.raises(ValueError):
        features.TfIdf.fit(reviews.limit(0), "review_text")


def test_vocabulary_cap_prefers_frequent_terms(reviews):
    fitted = features.TfIdf.fit(reviews, "review_text", max_features=2)
    # "train", "ride" and "train ride" occur once in every text; a tie goes to the smaller term
    assert set(fitted.terms) == {"ride", "train"}


def test_model_beats_the_majority_class(reviews, model):
    test = splits.with_split(cleaning.prepare_cleaned(reviews)).filter("split = 'test'")
    q = evaluation.quality(model.transform(test)).first()
    assert q["accuracy"] > 0.9 > 240 / 340 and q["macro_f1"] > 0.85


def test_probabilities_and_confidence(reviews, model):
    row = model.transform(reviews).select(
        F.max(F.abs(F.col("p_negative") + F.col("p_neutral") + F.col("p_positive") - 1)).alias("off"),
        F.max(F.abs(F.greatest("p_negative", "p_neutral", "p_positive") - F.col("sentiment_confidence"))).alias("gap")).first()
    assert row["off"] < 1e-9 and row["gap"] <= 5e-5 + 1e-12


def test_fit_minimises_the_stated_objective(reviews, model):
    """At the optimum the gradient of 0.5*|W|^2 + C * sum(w * loss) vanishes."""
    train = splits.with_split(cleaning.prepare_cleaned(reviews)).filter("split = 'train'")
    fitted = classifier.SentimentModel.fit(train, max_iter=2000)
    vectors = fitted.features.transform(classifier.with_pair(train), classifier.PAIR).select("features", "sentiment").collect()
    x = np.array([r["features"].toArray() for r in vectors])
    y = np.array([fitted.classes.index(r["sentiment"]) for r in vectors])
    n = np.bincount(y)
    w = (len(y) / (3 * n))[y]
    W, b = fitted.regression.coefficientMatrix.toArray(), fitted.regression.interceptVector.toArray()
    z = x @ W.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gradient = W + 2.0 * ((w[:, None] * (p - np.eye(3)[y])).T @ x)
    assert np.abs(gradient).max() < 0.05 * np.abs(W).max()


def test_save_and_load(spark, reviews, model, tmp_path):
    path = str(tmp_path / "model")
    model.save(path)
    again = classifier.SentimentModel.load(path)
    columns = ["review_id", "sentiment_pred", "sentiment_confidence"]
    assert sorted(model.transform(reviews).select(columns).collect()) == sorted(again.transform(reviews).select(columns).collect())


def test_attribution_sums_to_the_logit(reviews, model):
    mean = attribution.background_mean(reviews, model, n=50)
    explained = attribution.explain(reviews.limit(20), model, mean, top_k=None).toPandas()
    coefficients = model.regression.coefficientMatrix.toArray()
    vectors = model.features.transform(classifier.with_pair(reviews.limit(20)), classifier.PAIR).select("review_id", "features").collect()
    for r in vectors:
        own = explained[explained.review_id == r["review_id"]]
        c = model.classes.index(own.sentiment_pred.iloc[0])
        x = r["features"].toArray()
        logit = coefficients[c] @ x + model.regression.interceptVector[c]
        absent = -(coefficients[c] * mean)[x == 0].sum()
        assert own.base_value.iloc[0] + own.value.sum() + absent == pytest.approx(logit)


def test_attribution_top_k(reviews, model):
    mean = attribution.background_mean(reviews, model, n=50)
    all_rows = attribution.explain(reviews.limit(5), model, mean, top_k=None).toPandas()
    top = attribution.explain(reviews.limit(5), model, mean, top_k=3).toPandas()
    for key, own in all_rows.groupby("review_id"):
        want = own.value.abs().nlargest(3).round(9).tolist()
        assert top[top.review_id == key].sort_values("rank").value.abs().round(9).tolist() == want


def test_oversampling_balances_and_keeps_originals(spark, reviews):
    rows = classifier.with_pair(reviews)
    fitted = features.TfIdf.fit(rows, classifier.PAIR)
    vectors = fitted.transform(rows, classifier.PAIR)
    out = oversampling.interpolate_minority(vectors).cache()
    assert {r["sentiment"]: r["count"] for r in out.groupBy("sentiment").count().collect()} == dict.fromkeys(SENTIMENTS, 240)
    originals = out.filter("copy = 0")
    assert originals.count() == 340 and originals.select("review_id").distinct().count() == 340

    # every synthetic row lies on the segment to one of the three nearest of its class
    own = {r["review_id"]: r["features"].toArray() for r in vectors.filter("sentiment = 'Neutral'").collect()}
    ids, matrix = list(own), np.array(list(own.values()))
    for r in out.filter("sentiment = 'Neutral' AND copy > 0").limit(25).collect():
        base, point = own[r["review_id"]], r["features"].toArray()
        score = np.round(matrix @ base, 12)
        score[ids.index(r["review_id"])] = -np.inf
        near = [i for i in range(len(ids)) if score[i] >= np.sort(score)[-3]]
        ok = False
        for i in near:
            d = matrix[i] - base
            u = (point - base) @ d / (d @ d) if d @ d else 0
            ok |= -1e-9 <= u <= 1 + 1e-9 and np.allclose(base + u * d, point)
        assert ok
    repeated = oversampling.repeat_minority(reviews)
    assert {r["count"] for r in repeated.groupBy("sentiment").count().collect()} == {240}


def test_thresholds(spark):
    df = spark.createDataFrame([(0.5, 0.28, 0.22), (0.4, 0.4, 0.2), (0.1, 0.2, 0.7), (0.34, 0.33, 0.33)],
                               "p_negative double, p_neutral double, p_positive double")
    cut = {"Negative": 0.45, "Neutral": 0.25, "Positive": 0.65}
    got = [r[0] for r in df.select(thresholds.decide(classifier.PROBABILITIES, cut)).collect()]
    assert got == ["Negative", "Neutral", "Positive", "Neutral"]
    none = {"Negative": 0.9, "Neutral": 0.9, "Positive": 0.9}
    assert [r[0] for r in df.select(thresholds.decide(classifier.PROBABILITIES, none)).collect()] == [
        "Negative", "Negative", "Positive", "Negative"]
    tied = spark.createDataFrame([(0.5, 0.5, 0.0)], df.schema)
    same = {"Negative": 0.25, "Neutral": 0.25, "Positive": 0.25}
    assert tied.select(thresholds.decide(classifier.PROBABILITIES, same)).first()[0] == "Neutral"
    assert len(thresholds.GRID) == 14


def test_external_scorer(spark, reviews):
    def load():
        return lambda aspects, texts: np.array([[0.0, 0.0, 5.0 if "great" in t else -5.0] for t in texts])
    out = classifier.score_with(reviews, load)
    row = out.filter(F.col("review_text").contains("great")).first()
    assert row["sentiment_pred"] == "Positive" and row["sentiment_confidence"] == pytest.approx(0.9867, abs=1e-4)


def test_variant_selection(spark):
    good = spark.createDataFrame([("Positive", "Positive"), ("Negative", "Negative")], "sentiment string, sentiment_pred string")
    bad = spark.createDataFrame([("Positive", "Negative"), ("Negative", "Negative")], "sentiment string, sentiment_pred string")
    assert classifier.select_variant({"first": bad, "second": good})[0] == "second"
    assert classifier.select_variant({"first": good, "second": good})[0] == "first"


def test_topics(spark, reviews):
    found = topics.topics(reviews, k=2, n_words=4, max_iter=5)
    assert found.count() == 8
    assert topics.topics(reviews.limit(3), k=2).count() == 0
    assert topics.topics(reviews, k=2, min_df=10_000).count() == 0


def test_training_jobs(spark, reviews, tmp_path):
    result = jobs.train(spark, reviews, str(tmp_path / "out"), max_iter=40)
    assert {r["split"] for r in result.summary.collect()} == {"val", "test"}
    assert sum(r["rows"] for r in result.rows.collect()) == 340
    assert spark.read.json(str(tmp_path / "out" / "summary")).count() == 2
    assert result.reports["test_report"].count() == 3

    first_generation = reviews.withColumn("aspect", F.lit("Safety"))
    first = str(tmp_path / "first")
    out = jobs.train_with_thresholds(spark, first_generation, use_predicted_aspect=True, max_iter=40, out=first)
    assert spark.read.json(f"{first}/metrics").count() == 3
    assert spark.read.parquet(f"{first}/aspect_cache").count() == out["cache"].count()
    assert out["variant"] in ("tfidf_logreg_classweight_balanced", "tfidf_logreg_smote")
    assert set(out["thresholds"]) == set(SENTIMENTS) and out["test_report"].count() == 3
    assert out["cache"].count() > 0

    scored = jobs.score_table(reviews, result.model, str(tmp_path / "scored"))
    assert scored.columns[-3:] == ["aspect_pred", "sentiment_pred", "sentiment_confidence"]
    assert spark.read.parquet(str(tmp_path / "scored")).count() == 340

    path = tmp_path / "lines.txt"
    path.write_text("great train\n\n  dirty seats  \n")
    rows = jobs.score_file(spark, str(path), result.model).collect()
    assert sorted(r["text"] for r in rows) == ["dirty seats", "great train"]


def test_text_artifacts(spark, reviews):
    dated = reviews.withColumn("created_at_date", F.lit("2020-01-02"))
    tables = jobs.text_artifacts(dated)
    assert tables["nss_daily"].first()["rows"] == 340
    assert tables["cloud_positive"].first()["weight"] == 1.0


def test_rows_only_queries(spark, sf_dir):
    from checks import spark_query
    scored = spark_query("score_reviews")(spark, sf_dir)
    assert scored.count() == Views(spark, sf_dir).texts.count()
    sizes = {r["count"] for r in spark_query("oversample")(spark, sf_dir).groupBy("sentiment").count().collect()}
    assert len(sizes) == 1

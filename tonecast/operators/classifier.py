"""Sentiment classifier: TF-IDF with class-weighted multinomial logistic regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tonecast.functions import expressions as ex
from tonecast.operators import evaluation, regression, scaling
from tonecast.operators.cleaning import with_rule_aspect
from tonecast.operators.features import MAX_FEATURES, TfIdf
from tonecast.schema import SENTIMENTS
from tonecast.session import materialize

PAIR = "_pair"
# relative change of the objective at which a fit has converged
TOLERANCE = 1e-6
# training rows above which the steps of a fit send the driver one compact sum (see ``regression``)
_MANY_ROWS = 2_000
PROBABILITIES = {s: f"p_{s.lower()}" for s in SENTIMENTS}


def with_pair(df: DataFrame, aspect: str = "aspect") -> DataFrame:
    return df.withColumn(PAIR, ex.model_input(F.col(aspect), F.col("review_text")))


def class_weights(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """Balanced weight ``N / (K * n_k)`` per class."""
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = Window.partitionBy(F.lit(0))  # one row per class
    total, kinds = F.sum("n").over(classes), F.count(F.lit(1)).over(classes)
    return n.select(label, "n", (total / (kinds * F.col("n"))).alias("weight"))


def attach_weights(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """Class weight of every labelled row; the weight table has one row per sentiment, at most three."""
    known = df.filter(F.col(label).isin(*SENTIMENTS))
    return known.join(F.broadcast(class_weights(known, label).select(label, "weight")), label)


@dataclass
class SentimentModel:
    """Fitted features and regression; ``classes`` gives the label of every class index, ``steps`` those of the fit."""

    features: TfIdf
    regression: LogisticRegressionModel
    classes: list[str]
    steps: int | None = None

    @staticmethod
    def fit(train: DataFrame, aspect: str = "aspect", label: str = "sentiment", C: float = 2.0, max_iter: int = 2000,
            balanced: bool = True, sublinear: bool = True, min_df: int = 2,
            max_features: int = MAX_FEATURES) -> "SentimentModel":
        """Train on labelled rows. ``C`` is the inverse penalty per unit of summed row weight."""
        # vocabulary, row count, class sizes and vectors each read the rows; what chose them runs once
        rows = materialize(with_pair(train.filter(F.col(label).isin(*SENTIMENTS)), aspect).select(PAIR, label), "train")
        features = TfIdf.fit(rows, PAIR, max_features, min_df, sublinear)
        vectors = features.transform(rows, PAIR).select("features", label)
        return SentimentModel.fit_vectors(features, vectors, label, C, max_iter, balanced)

    @staticmethod
    def fit_vectors(features: TfIdf, vectors: DataFrame, label: str, C: float, max_iter: int,
                    balanced: bool) -> "SentimentModel":
        """Train on ready feature vectors."""
        # three counts at most; they fix class order and weights
        n = {r[label]: r["count"] for r in vectors.groupBy(label).count().collect()}
        classes = sorted(n)
        total = sum(n.values())
        index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
        weight = F.lit(1.0)
        if balanced:
            for c in classes:
                weight = F.when(F.col(label) == c, total / (len(classes) * n[c])).otherwise(weight)
        rows = vectors.select("features", index.cast("double").alias("_y"), weight.cast("double").alias("_w"))
        if len(classes) > 1 and total > _MANY_ROWS:
            fitted, steps = regression.fit(rows, len(classes), len(features.idf), total, 1.0 / (C * total), max_iter, TOLERANCE)
            return SentimentModel(features, fitted, classes, steps)
        rows, depth = scaling.for_steps(materialize(scaling.compact(rows, total), "instances"), total)
        estimator = LogisticRegression(
            featuresCol="features", labelCol="_y", weightCol="_w", family="multinomial", standardization=False,
            elasticNetParam=0.0, regParam=1.0 / (C * total), maxIter=max_iter, tol=TOLERANCE,
            aggregationDepth=depth)
        fitted = estimator.fit(rows)
        return SentimentModel(features, fitted, classes, fitted.summary.totalIterations)

    def transform(self, df: DataFrame, aspect: str = "aspect", keep_features: bool = False) -> DataFrame:
        """Map-only scoring: probabilities per class, predicted label, confidence to four places.

        ``keep_features`` leaves the weighted terms in ``features``, for what explains the scores.
        """
        vectors = self.features.transform(with_pair(df, aspect), PAIR, "features")
        model = self.regression.setFeaturesCol("features").setProbabilityCol("_prob")
        model = model.setRawPredictionCol("").setPredictionCol("")
        out = model.transform(vectors).withColumn("_p", vector_to_array("_prob"))
        labels = F.array(*[F.lit(c) for c in self.classes])
        out = out.withColumn("_top", F.array_max("_p"))
        probs = {PROBABILITIES[s]: (F.col("_p")[self.classes.index(s)] if s in self.classes else F.lit(0.0))
                 for s in SENTIMENTS}
        return out.withColumns({
            **probs, "sentiment_pred": F.element_at(labels, F.array_position("_p", F.col("_top")).cast("int")),
            "sentiment_confidence": F.bround("_top", 4)}).drop(PAIR, "_prob", "_p", "_top", *([] if keep_features else ["features"]))

    def save(self, path: str) -> None:
        """Features, regression and class order, each in its own folder under ``path``."""
        self.features.save(f"{path}/features")
        self.regression.write().overwrite().save(f"{path}/regression")
        classes = SparkSession.active().createDataFrame(list(enumerate(self.classes)), "index int, label string")
        classes.write.mode("overwrite").parquet(f"{path}/classes")

    @staticmethod
    def load(path: str) -> "SentimentModel":
        classes = SparkSession.active().read.parquet(f"{path}/classes").orderBy("index").collect()
        return SentimentModel(TfIdf.load(f"{path}/features"), LogisticRegressionModel.load(f"{path}/regression"),
                              [r["label"] for r in classes])


def score_reviews(df: DataFrame, model: SentimentModel) -> DataFrame:
    """Keyword aspect first, then the sentiment for that aspect."""
    return model.transform(with_rule_aspect(df, batched=True), "aspect_pred").drop(*PROBABILITIES.values())


def prediction_view(scored: DataFrame) -> DataFrame:
    return scored.select(ex.preview(F.col("review_text"), 200).alias("text"), F.col("aspect_pred").alias("aspect"),
                         F.col("sentiment_pred").alias("sentiment"), F.col("sentiment_confidence").alias("confidence"))


def score_with(df: DataFrame, load: Callable[[], Callable[[list[str], list[str]], np.ndarray]],
               classes: list[str] = SENTIMENTS, aspect: str = "aspect") -> DataFrame:
    """Batch scoring by an external model.

    ``load`` runs once per task and returns ``f(aspects, texts) -> (n, classes) logits``; Arrow
    batches pass through it and softmax and argmax follow.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("sentiment_pred", T.StringType()),
                                              T.StructField("sentiment_confidence", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            if not len(pdf):
                continue
            logits = np.asarray(model(pdf[aspect].tolist(), pdf["review_text"].fillna("").tolist()), dtype="float64")
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            yield pdf.assign(sentiment_pred=[classes[i] for i in p.argmax(axis=1)],
                             sentiment_confidence=p.max(axis=1).round(4))

    return df.mapInPandas(run, schema)


def select_variant(variants: dict[str, DataFrame], pred: str = "sentiment_pred") -> tuple[str, dict[str, float]]:
    """Variant with the highest validation macro-F1; the first one keeps a tie."""
    scores = {name: evaluation.quality(df, pred=pred).first()["macro_f1"] for name, df in variants.items()}
    best = None
    for name, value in scores.items():
        if best is None or value > scores[best]:
            best = name
    return best, scores

"""Queries on evaluation, errors, thresholds, features and models."""

from pyspark.sql import functions as F

from checks.registry import check, rounded
from tonecast.functions import expressions as ex
from tonecast.operators import (attribution, classifier, cleaning, errors, evaluation, features, oversampling, splits,
                                thresholds, topics)
from tonecast.session import materialize

LABELS = ("Negative", "Neutral", "Positive")


# ---- evaluation ------------------------------------------------------------------------

def _report(view="reviews", key=None, true="sentiment", pred="sentiment_pred", explicit=True):
    keys, comma, on = (f"{key}, ", f"{key}, ", f"USING ({key}, label)") if key else ("", "", "USING (label)")
    base = f"SELECT DISTINCT {keys}l.label FROM {view}, (VALUES ('Negative'), ('Neutral'), ('Positive')) AS l(label)" if explicit else \
        f"SELECT {keys}{true} AS label FROM {view} UNION SELECT {keys}{pred} FROM {view}"
    return f"""base AS ({base}),
  ac AS (SELECT {comma}{true} AS label, count(*) AS support, count(*) FILTER (WHERE {true} = {pred}) AS tp FROM {view} GROUP BY ALL),
  pr AS (SELECT {comma}{pred} AS label, count(*) AS predicted FROM {view} GROUP BY ALL),
  pc AS (SELECT base.*, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
    FROM base LEFT JOIN ac {on} LEFT JOIN pr {on}),
  report AS (SELECT {comma}label, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS recall,
    coalesce(CAST(2 * tp AS DOUBLE) / nullif(support + predicted, 0), 0) AS f1, support, tp FROM pc)"""


_AVERAGES = ("CAST(sum(support) AS BIGINT) AS \"rows\", CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, " + ", ".join(
    f"round(avg({m}), 9) AS macro_{m}, round(sum({m} * support) / sum(support), 9) AS weighted_{m}" for m in ("precision", "recall", "f1")))
_MEANS = [f"{k}_{m}" for m in ("precision", "recall", "f1") for k in ("macro", "weighted")]


@check("class_report", views="reviews", ctes=_report(), sql="SELECT * FROM report")
def class_report(v):
    return evaluation.class_report(v.reviews)


@check("accuracy_f1", views="reviews", ctes=_report(explicit=False), sql=f"SELECT {_AVERAGES} FROM report")
def accuracy_f1(v):
    return rounded(evaluation.quality(v.reviews), *_MEANS, digits=9)


@check("accuracy_f1_all_labels", views="reviews", ctes=_report(), sql=f"SELECT {_AVERAGES} FROM report")
def accuracy_f1_all_labels(v):
    return rounded(evaluation.averages(evaluation.class_report(v.reviews)), *_MEANS, digits=9)


@check("class_report_by_aspect", views="reviews", ctes=_report(key="aspect") + """,
  n AS (SELECT aspect, count(*) AS "rows" FROM reviews GROUP BY aspect HAVING count(*) >= 30)""",
       sql="SELECT * FROM report JOIN n USING (aspect)")
def class_report_by_aspect(v):
    return evaluation.class_report_by(v.reviews, "aspect")


# aspect and month of the texts make groups that lack a label, where both macro rules differ
@check("quality_by_group_present_labels", views="scored", ctes=_report("scored", "reviewer_hometown", explicit=False),
       sql=f"SELECT reviewer_hometown, {_AVERAGES} FROM report WHERE reviewer_hometown IS NOT NULL GROUP BY reviewer_hometown HAVING sum(support) >= 5")
def quality_by_group_present_labels(v):
    return rounded(evaluation.quality_by(v.scored, "reviewer_hometown", 5), *_MEANS, digits=9)


@check("quality_by_group_all_labels", views="scored", ctes=_report("scored", "reviewer_hometown"),
       sql=f"SELECT reviewer_hometown, {_AVERAGES} FROM report WHERE reviewer_hometown IS NOT NULL GROUP BY reviewer_hometown HAVING sum(support) >= 5")
def quality_by_group_all_labels(v):
    return rounded(evaluation.quality_by(v.scored, "reviewer_hometown", 5, labels=list(LABELS)), *_MEANS, digits=9)


# a row without a true label is one of its group that nothing matches
@check("quality_by_missing_labels", views="texts", ctes="gu AS (SELECT *, 'Positive' AS sentiment_pred FROM texts), "
       + _report("gu", "lang", explicit=False) + """, n AS (SELECT lang, count(*) AS n FROM gu WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 30)""",
       sql=f"""SELECT lang, n AS "rows", CAST(sum(tp) AS DOUBLE) / n AS accuracy, {_AVERAGES.split(' AS accuracy, ', 1)[1]}
  FROM report JOIN n USING (lang) WHERE label IS NOT NULL GROUP BY lang, n""")
def quality_by_missing_labels(v):
    guessed = v.texts.withColumn("sentiment_pred", F.lit("Positive"))
    return rounded(evaluation.quality_by(guessed, "lang"), *_MEANS, digits=9)


_GRID = "(VALUES ('Negative'), ('Neutral'), ('Positive'))"


@check("confusion", views="reviews", ctes=f"""c AS (SELECT t.label AS true_label, p.label AS pred_label,
  (SELECT count(*) FROM reviews WHERE sentiment = t.label AND sentiment_pred = p.label) AS "rows" FROM {_GRID} AS t(label), {_GRID} AS p(label))""",
       sql='SELECT *, CAST("rows" AS DOUBLE) / greatest(sum("rows") OVER (PARTITION BY true_label), 1) AS share FROM c')
def confusion(v):
    return evaluation.confusion(v.reviews)


@check("aspect_confusion", views="reviews", ctes="""u AS (SELECT aspect AS label FROM reviews UNION SELECT aspect_pred FROM reviews),
  n AS (SELECT aspect, aspect_pred, count(*) AS n FROM reviews GROUP BY ALL),
  c AS (SELECT t.label AS true_label, p.label AS pred_label, coalesce(n, 0) AS "rows" FROM u t CROSS JOIN u p LEFT JOIN n ON aspect = t.label AND aspect_pred = p.label)""",
       sql='SELECT *, CAST("rows" AS DOUBLE) / greatest(sum("rows") OVER (PARTITION BY true_label), 1) AS share FROM c')
def aspect_confusion(v):
    return evaluation.union_confusion(v.reviews)


@check("aspect_agreement", views="reviews", sql="""SELECT count(*) AS "rows",
  CAST(count(*) FILTER (WHERE aspect = aspect_pred) AS DOUBLE) / count(*) AS agreement FROM reviews""")
def aspect_agreement(v):
    return evaluation.agreement(v.reviews)


@check("calibration", views="reviews", ctes="""b AS (SELECT min(sentiment_confidence) AS lo, (max(sentiment_confidence) - min(sentiment_confidence)) / 10 AS w FROM reviews),
  c AS (SELECT *, 1 + len(list_filter(range(1, 10), lambda k: sentiment_confidence > lo + k * w)) AS bin FROM reviews, b)""",
       sql="""SELECT CAST(bin AS INT) AS bin, CAST(count(*) FILTER (WHERE sentiment = sentiment_pred) AS DOUBLE) / count(*) AS accuracy,
  round(avg(sentiment_confidence), 6) AS avg_conf, count(*) AS "rows" FROM c GROUP BY bin""")
def calibration(v):
    return rounded(evaluation.calibration(v.reviews), "avg_conf")


@check("model_comparison", views="reviews", ctes=_report(explicit=False) + ", q AS (SELECT " + _AVERAGES + " FROM report)",
       sql="""SELECT 'labelled' AS model, 'all' AS split, accuracy AS acc, macro_f1 FROM q UNION ALL SELECT 'perfect', 'all', 1.0, 1.0""")
def model_comparison(v):
    perfect = v.reviews.withColumn("sentiment_pred", F.col("sentiment"))
    return rounded(evaluation.comparison([("labelled", "all", v.reviews), ("perfect", "all", perfect)]), "macro_f1", digits=9)


# ---- errors ----------------------------------------------------------------------------

_TYPES = {
    "false_positive": "sentiment = 'Negative' AND sentiment_pred = 'Positive'",
    "false_negative": "sentiment = 'Positive' AND sentiment_pred = 'Negative'",
    "false_neutral": "sentiment <> 'Neutral' AND sentiment_pred = 'Neutral'",
    "missed_neutral": "sentiment = 'Neutral' AND sentiment_pred <> 'Neutral'",
    "low_confidence": "sentiment <> sentiment_pred AND sentiment_confidence < 0.6",
}
_COUNTED = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _TYPES.items())


@check("error_summary", views="reviews", sql=f"""SELECT count(*) AS total, count(*) FILTER (WHERE sentiment <> sentiment_pred) AS total_errors, {_COUNTED},
  CAST(count(*) FILTER (WHERE sentiment <> sentiment_pred) AS DOUBLE) / greatest(count(*), 1) * 100 AS error_rate FROM reviews""")
def error_summary(v):
    return errors.error_summary(v.reviews)


@check("error_types", views="reviews", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS error_type, count(*) AS \"rows\" FROM reviews WHERE {c}" for n, c in _TYPES.items()))
def error_types(v):
    return errors.error_type_counts(v.reviews)


@check("error_by_aspect", views="reviews", ctes=f"""g AS (SELECT aspect, count(*) AS "rows", count(*) FILTER (WHERE sentiment <> sentiment_pred) AS errors,
  count(*) FILTER (WHERE {_TYPES['false_positive']}) AS fp, count(*) FILTER (WHERE {_TYPES['false_negative']}) AS fn,
  count(*) FILTER (WHERE {_TYPES['false_neutral']}) AS false_neutral FROM reviews GROUP BY aspect HAVING count(*) >= 20)""",
       sql='SELECT *, CAST(errors AS DOUBLE) / "rows" * 100 AS error_rate FROM g')
def error_by_aspect(v):
    return errors.errors_by(v.reviews)


def _samples(view):
    return f"""u AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS error_type FROM {view} WHERE {c}" for n, c in _TYPES.items())}),
  s AS (SELECT *, CAST(row_number() OVER (PARTITION BY error_type ORDER BY md5('42:' || review_id), review_id) AS INT) AS rank FROM u)"""


@check("error_samples", views="reviews", ctes=_samples("reviews"),
       sql="SELECT error_type, rank, review_id, sentiment, sentiment_pred FROM s WHERE rank <= 8")
def error_samples(v):
    return errors.error_samples(v.reviews).select("error_type", "rank", "review_id", "sentiment", "sentiment_pred")


@check("error_samples_view", views="scored", ctes=_samples("scored"), sql="""SELECT error_type, rank, substring(review_text, 1, 350) AS text,
  coalesce(review_rating, 0) AS rating, coalesce(source, '') AS source, sentiment, date, aspect, sentiment_pred AS predicted,
  round_even(sentiment_confidence, 3) AS confidence FROM s WHERE rank <= 8""")
def error_samples_view(v):
    return errors.sample_view(errors.error_samples(v.scored), "error_type", "rank")


@check("misclassified_head", views="scored", sql="""SELECT review_id, aspect, sentiment AS y_true, sentiment_pred AS y_pred,
  substring(review_text, 1, 180) AS text_preview FROM scored WHERE sentiment <> sentiment_pred ORDER BY review_id LIMIT 30""")
def misclassified_head(v):
    return errors.first_errors(v.scored)


# ---- thresholds ------------------------------------------------------------------------

_PROBS = classifier.PROBABILITIES
_CURVE = f"""gr AS (SELECT i - 1 AS step, CAST(t AS DOUBLE) AS threshold FROM (VALUES {', '.join(f"({i + 1}, '{t!r}')" for i, t in enumerate(thresholds.GRID))}) AS g(i, t)),
  pl AS ({' UNION ALL '.join(f"SELECT '{s}' AS label, {p} AS p, sentiment = '{s}' AS y FROM probs" for s, p in _PROBS.items())}),
  cu AS (SELECT label, step, threshold, coalesce(CAST(2 * count(*) FILTER (WHERE y AND p >= threshold) AS DOUBLE)
     / nullif(count(*) FILTER (WHERE p >= threshold) + count(*) FILTER (WHERE y), 0), 0) AS f1 FROM pl CROSS JOIN gr GROUP BY label, step, threshold),
  be AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, step) AS k FROM cu)"""


@check("threshold_curve", views="probs", ctes=_CURVE, sql="SELECT label, CAST(step AS INT) AS step, threshold, f1 FROM cu")
def threshold_curve(v):
    return thresholds.f1_curve(v.probs, _PROBS)


@check("threshold_tune", views="probs", ctes=_CURVE, sql="SELECT label, threshold, f1 FROM be WHERE k = 1")
def threshold_tune(v):
    return thresholds.tune(v.probs, _PROBS)


_CUTS = {"Negative": 0.45, "Neutral": 0.6, "Positive": 0.45}


@check("threshold_predict", views="probs", ctes=" ".join(["m AS (SELECT review_id, p_negative, p_neutral, p_positive, unnest([",
       ", ".join(f"{{'l': '{s}', 'p': {p}, 't': CAST('{_CUTS[s]}' AS DOUBLE)}}" for s, p in _PROBS.items()), "]) AS u FROM probs),",
       "r AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY CASE WHEN u.p >= u.t THEN 0 ELSE 1 END, "
       "CASE WHEN u.p >= u.t THEN u.p - u.t END DESC, CASE WHEN u.p >= u.t THEN u.l END DESC, u.p DESC, u.l) AS k FROM m)"]),
       sql="SELECT review_id, u.l AS decision FROM r WHERE k = 1")
def threshold_predict(v):
    return v.probs.select("review_id", thresholds.decide(_PROBS, _CUTS).alias("decision"))


# ---- features and models ---------------------------------------------------------------

_WEIGHTS = "w AS (SELECT sentiment, count(*) AS n, (SELECT count(*) FROM texts WHERE sentiment IS NOT NULL) / (3 * CAST(count(*) AS DOUBLE)) AS weight FROM texts WHERE sentiment IS NOT NULL GROUP BY sentiment)"


@check("class_weights", views="texts", ctes=_WEIGHTS, sql="SELECT * FROM w")
def class_weights(v):
    return classifier.class_weights(v.texts)


@check("class_weights_attached", views="texts", ctes=_WEIGHTS, sql="SELECT review_id, texts.sentiment, weight FROM texts JOIN w ON w.sentiment = texts.sentiment")
def class_weights_attached(v):
    return classifier.attach_weights(v.texts).select("review_id", "sentiment", "weight")


def _tfidf(sublinear, min_df):
    tf = "1 + ln(n)" if sublinear else "n"
    return f"""u AS (SELECT review_id, regexp_extract_all(lower('Aspect: ' || aspect || chr(10) || 'Review: ' || review_text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM scored),
  g AS (SELECT review_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM u),
  tf AS (SELECT review_id, term, count(*) AS n FROM g GROUP BY ALL),
  vo AS (SELECT term, sum(n) AS cf, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= {min_df} ORDER BY cf DESC, term LIMIT 80000),
  ra AS (SELECT review_id, term, ({tf}) * (ln((1 + (SELECT count(*) FROM scored)) / (1 + df)) + 1) AS x FROM tf JOIN vo USING (term)),
  no AS (SELECT review_id, sqrt(sum(x * x)) AS norm FROM ra GROUP BY review_id)"""


def _pairs(v):
    return classifier.with_pair(v.scored_batched)


@check("tfidf_weights", views="scored", ctes=_tfidf(True, 2), sql="SELECT review_id, term, round(x / norm, 9) AS weight FROM ra JOIN no USING (review_id)")
def tfidf_weights(v):
    model = features.TfIdf.fit(_pairs(v), classifier.PAIR)
    return rounded(features.weights_table(model, _pairs(v), classifier.PAIR, "review_id"), "weight", digits=9)


@check("vocabulary_summarised", views="scored", ctes=_tfidf(True, 2).replace("LIMIT 80000", "LIMIT 500"), sql="SELECT term, CAST(cf AS BIGINT) AS cf, df FROM vo")
def vocabulary_summarised(v):
    """The 500 most frequent terms through bounded summaries and a recount of the candidates."""
    return v.spark.createDataFrame(features.vocabulary(_pairs(v), classifier.PAIR, 500, capacity=20_000), "term string, cf long, df long")


@check("tfidf_raw_counts", views="scored", ctes=_tfidf(False, 1), sql="""SELECT review_id, count(*) AS terms, round(sum(x / norm), 6) AS total, round(max(x / norm), 6) AS largest
  FROM ra JOIN no USING (review_id) GROUP BY review_id""")
def tfidf_raw_counts(v):
    model = features.TfIdf.fit(_pairs(v), classifier.PAIR, min_df=1, sublinear=False)
    values = F.transform(features.entries(F.col("features")), lambda e: e["value"])
    rows = model.transform(_pairs(v), classifier.PAIR).select("review_id", values.alias("x"))
    return rounded(rows.select("review_id", F.size("x").cast("long").alias("terms"),
                               F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total"), F.array_max("x").alias("largest")),
                   "total", "largest")


def _labelled(v):
    return cleaning.with_rule_aspect(v.texts.filter("sentiment IS NOT NULL"), "aspect", batched=True)


_fitted: dict[tuple[str, str], classifier.SentimentModel] = {}


def _model(v):
    """The sentiment model of a folder's texts, fitted to convergence once per application."""
    key = v.spark.sparkContext.applicationId, v.dir
    if key not in _fitted:
        train = splits.with_split(_labelled(v).withColumn("text_id", ex.text_id(F.col("review_text")))).filter("split = 'train'")
        _fitted[key] = classifier.SentimentModel.fit(train)
    return _fitted[key]


@check("model_state", views="texts", sql="""SELECT count(*) AS scored_rows, count(*) AS in_range, count(*) AS known_labels, true AS converged FROM texts""")
def model_state(v):
    """Every row gets a label of the taxonomy and a confidence, and the fit ended before its limit of steps."""
    model = _model(v)
    found = classifier.score_reviews(v.texts, model)
    done = model.steps < 2000
    return found.agg(F.count("*").alias("scored_rows"), F.count_if(F.col("sentiment_confidence").between(1 / 3 - 1e-3, 1)).alias("in_range"),
                     F.count_if(F.col("sentiment_pred").isin(*LABELS)).alias("known_labels")).withColumn("converged", F.lit(done))


@check("score_reviews")
def score_reviews(v):
    return classifier.score_reviews(v.texts, _model(v)).select("review_id", "aspect_pred", "sentiment_pred", "sentiment_confidence")


@check("predict_view")
def predict_view(v):
    return classifier.prediction_view(classifier.score_reviews(v.texts, _model(v)))


@check("token_attribution")
def token_attribution(v):
    model, rows = _model(v), cleaning.with_rule_aspect(v.texts, "aspect", batched=True)
    return attribution.explain(rows, model, attribution.background_mean(rows, model))


@check("oversample")
def oversample(v):
    """Synthetic rows for the smaller classes of the training split."""
    labelled = splits.with_split(_labelled(v).withColumn("text_id", ex.text_id(F.col("review_text"))))
    rows = materialize(classifier.with_pair(labelled.filter("split = 'train'")).select("review_id", "sentiment", classifier.PAIR), "train")
    model = features.TfIdf.fit(rows, classifier.PAIR, min_df=2)
    vectors = model.transform(rows, classifier.PAIR)
    balanced = oversampling.interpolate_minority(vectors)
    return balanced.select("review_id", "sentiment", "copy", F.size(features.entries(F.col("features"))).alias("n_terms"))


@check("oversample_repeat", views="texts", ctes="""l AS (SELECT * FROM texts WHERE sentiment IS NOT NULL),
  n AS (SELECT sentiment, count(*) AS n FROM l GROUP BY sentiment), mx AS (SELECT max(n) AS m FROM n),
  r AS (SELECT l.*, n, m, row_number() OVER (PARTITION BY l.sentiment ORDER BY md5('42:' || review_id), review_id) AS k FROM l JOIN n USING (sentiment), mx),
  t AS (SELECT *, (m - n) // n + CASE WHEN k <= (m - n) % n THEN 1 ELSE 0 END AS times FROM r)""",
       sql="SELECT review_id, sentiment, CAST(unnest(range(0, times + 1)) AS INT) AS copy FROM t")
def oversample_repeat(v):
    return oversampling.repeat_minority(v.texts.filter("sentiment IS NOT NULL")).select("review_id", "sentiment", "copy")


@check("lda_topics")
def lda_topics(v):
    return topics.topics_by_polarity(v.scored)

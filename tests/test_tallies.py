import pytest
from pyspark.sql import functions as F

from tonecast.operators import cleaning, errors, evaluation, insights, profile, tallies, trends
from tonecast.plans import reports
from tonecast.operators.filters import Filters

SCHEMA = ("review_id string, review_text string, review_rating int, source string, created_at_date timestamp, bts_line string, "
          "reviewer_hometown string, aspect string, sentiment string, aspect_pred string, sentiment_pred string, "
          "sentiment_confidence double")


def table(spark, rows):
    """rows: (aspect, sentiment, month text, count)."""
    spec = spark.createDataFrame(rows, "aspect string, sentiment string, ym string, n int")
    df = spec.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    return cleaning.with_calendar(df.select(
        F.concat_ws("-", "aspect", "sentiment", "ym", "i").alias("review_id"), F.lit("nice clean train").alias("review_text"),
        F.lit(5).alias("review_rating"), F.lit("web").alias("source"),
        F.to_timestamp(F.concat("ym", F.lit("-15"))).alias("created_at_date"), F.lit(None).cast("string").alias("bts_line"),
        F.lit(None).cast("string").alias("reviewer_hometown"), "aspect", "sentiment", F.col("aspect").alias("aspect_pred"),
        F.col("sentiment").alias("sentiment_pred"), F.lit(0.9).alias("sentiment_confidence")))


def empty(spark):
    return cleaning.with_calendar(spark.createDataFrame([], SCHEMA))


def test_empty_input(spark):
    df = empty(spark)
    kpi = reports.kpis(df).first()
    assert (kpi["rows"], kpi["nss"], kpi["pct_positive"], kpi["avg_confidence"], kpi["date_min"]) == (0, 0.0, 0.0, 0.0, "")
    assert tallies.nss_by_aspect(df).count() == 0
    assert insights.insight_cards(df).count() == 0
    summary = insights.executive_summary(df).first()
    assert (summary["headline"], summary["top_pain"], summary["trend_direction"]) == ("No data.", "—", "stable")
    overall = reports.performance(df)["overall"].first()
    assert tuple(overall) == (0.0, 0.0, 0.0)
    detail = reports.aspect_detail(df, "Cleanliness")["summary"].first()
    assert (detail["rows"], detail["priority"], detail["direction"]) == (0, "monitor", "stable")
    assert detail["action"].startswith("Double cleaning")
    assert reports.aspect_detail(df, "Nothing")["summary"].first()["action"] == ""


def test_null_keys_count_in_totals_only(spark):
    df = table(spark, [("A", "Positive", "2020-01", 3), ("B", "Negative", "2020-01", 1)])
    df = df.withColumn("source", F.when(F.col("aspect") == "A", "web"))
    rows = tallies.breakdown(df, "source").collect()
    assert [(r["source"], r["rows"], r["pct"]) for r in rows] == [("web", 3, 75.0)]
    assert tallies.nss_table(df, "source").count() == 1


@pytest.mark.parametrize("pos,neg,neu,expected", [
    (0, 100, 400, "monitor"),    # nss = -20 exactly
    (0, 101, 399, "urgent"),     # below -20 with 500 rows
    (0, 101, 398, "monitor"),    # 499 rows
    (600, 0, 400, "leverage"),   # nss = 60 exactly, 1000 rows
    (600, 0, 399, "monitor"),    # 999 rows
])
def test_priority_boundaries(spark, pos, neg, neu, expected):
    rows = [("A", s, "2020-01", n) for s, n in (("Positive", pos), ("Negative", neg), ("Neutral", neu)) if n]
    assert insights.priorities(table(spark, rows)).first()["priority"] == expected


@pytest.mark.parametrize("later,expected", [(50, "stable"), (52, "stable"), (53, "improving"), (48, "stable"), (47, "declining")])
def test_trend_boundaries(spark, later, expected):
    # first month: 0; second month: (2*later - 100)
    df = table(spark, [("A", "Positive", "2020-01", 50), ("A", "Negative", "2020-01", 50)]
               + [("A", "Positive", "2020-02", later), ("A", "Negative", "2020-02", 100 - later)])
    assert trends.trend(df).first()["direction"] == expected


def test_trend_at_exactly_five_is_stable(spark):
    df = table(spark, [("A", "Neutral", "2020-01", 20), ("A", "Positive", "2020-02", 1), ("A", "Neutral", "2020-02", 19)])
    row = trends.trend(df).first()
    assert row["delta"] == 5.0 and row["direction"] == "stable"


def test_trend_halves_pool_rows_and_favour_the_recent_side(spark):
    df = table(spark, [("A", "Positive", "2020-01", 1), ("A", "Negative", "2020-05", 3), ("A", "Positive", "2020-07", 1)])
    row = trends.trend(df, "aspect").first()
    assert (row["months"], row["prior_nss"], row["recent_nss"]) == (3, 100.0, -50.0)
    single = trends.trend(table(spark, [("A", "Positive", "2020-01", 2)])).first()
    assert (single["prior_nss"], single["recent_nss"], single["delta"], single["direction"]) == (100.0, 100.0, 0.0, "stable")


def test_cards(spark):
    df = table(spark, [("Accessibility", "Negative", "2020-01", 500), ("Cleanliness", "Positive", "2020-01", 1000)])
    cards = insights.insight_cards(df.withColumn("aspect_pred", F.lit("Other")).withColumn(
        "sentiment_confidence", F.lit(0.4))).collect()
    assert [c["severity"] for c in cards] == ["critical", "good", "warning", "info"]
    assert cards[0]["finding"] == "NSS = -100.0% across 500 reviews — 100% are negative."
    assert cards[3]["finding"].startswith("100.0% of predictions are below 0.50 confidence")


def test_quadrant_medians(spark):
    df = table(spark, [("A", "Positive", "2020-01", 1), ("B", "Positive", "2020-01", 2), ("C", "Positive", "2020-01", 5),
                       ("D", "Positive", "2020-01", 9)])
    row = tallies.quadrant(df).first()
    assert (row["median_rows"], row["upper_median_rows"]) == (3.5, 5)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(7,), (7,)], "v int")
    row = profile.histogram(df, "v", 100, 50).collect()
    assert [(r["bin"], r["rows"]) for r in row] == [(25, 2)]


def test_seasonality_wide_has_twelve_months(spark):
    row = tallies.seasonality_wide(table(spark, [("A", "Positive", "2020-03", 2)])).first()
    assert row["M03"] == 2 and sum(row[f"M{m:02d}"] for m in range(1, 13)) == 2


def test_kpi_delta_hides_small_changes(spark):
    df = table(spark, [("A", "Positive", "2020-01", 2)])
    row = tallies.kpi_delta(df, F.lit(True)).first()
    assert row["rows_delta"] is None and row["nss_delta"] is None


def test_golden_confusion_matrix(spark):
    """Published validation counts give the published metrics."""
    counts = {("Negative", "Negative"): 177, ("Negative", "Neutral"): 37, ("Negative", "Positive"): 17,
              ("Neutral", "Negative"): 21, ("Neutral", "Neutral"): 165, ("Neutral", "Positive"): 54,
              ("Positive", "Negative"): 1, ("Positive", "Neutral"): 35, ("Positive", "Positive"): 493}
    spec = spark.createDataFrame([(t, p, n) for (t, p), n in counts.items()], "sentiment string, sentiment_pred string, n int")
    df = spec.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    q = evaluation.quality(df).first()
    assert q["accuracy"] == pytest.approx(0.835)
    assert q["macro_f1"] == pytest.approx(0.8057280044720163)
    assert q["weighted_f1"] == pytest.approx(0.8334230036207114)
    assert q["macro_precision"] == pytest.approx(0.8199210810012597)
    report = {r["label"]: r for r in evaluation.class_report(df).collect()}
    assert report["Negative"]["precision"] == pytest.approx(0.8894472361809045)
    assert report["Neutral"]["recall"] == pytest.approx(0.6875)
    assert report["Positive"]["f1"] == pytest.approx(0.9021043000914913)
    assert report["Positive"]["support"] == 529


def test_macro_rules_differ_when_a_label_is_absent(spark):
    df = spark.createDataFrame([("Positive", "Positive"), ("Negative", "Negative")], "sentiment string, sentiment_pred string")
    assert evaluation.quality(df).first()["macro_f1"] == 1.0
    assert evaluation.quality(df, labels=["Negative", "Neutral", "Positive"]).first()["macro_f1"] == pytest.approx(2 / 3)


def test_calibration_bins_are_right_closed(spark):
    import pandas as pd
    values = [0.0, 0.1, 0.2, 0.25, 0.3, 0.35, 0.7, 0.8, 0.95, 1.0]
    df = spark.createDataFrame([("P", "P", v) for v in values], "sentiment string, sentiment_pred string, sentiment_confidence double")
    expected = pd.Series(values).groupby(pd.cut(pd.Series(values), bins=10, include_lowest=True), observed=True).size().tolist()
    assert [r["rows"] for r in evaluation.calibration(df).orderBy("bin").collect()] == expected
    same = spark.createDataFrame([("P", "P", 0.5)] * 3, "sentiment string, sentiment_pred string, sentiment_confidence double")
    assert [tuple(r)[1:] for r in evaluation.calibration(same).collect()] == [(1.0, 0.5, 3)]


def test_error_types_with_missing_labels(spark):
    rows = [("Negative", "Positive", 0.9), ("Positive", "Negative", 0.5), ("Positive", "Neutral", 0.9), ("Neutral", "Positive", 0.59),
            (None, "Neutral", 0.9), ("Neutral", None, None), (None, None, 0.1), ("Neutral", "Neutral", 0.1)]
    df = spark.createDataFrame(rows, "sentiment string, sentiment_pred string, sentiment_confidence double")
    row = errors.error_summary(df).first().asDict()
    assert row == {"total": 8, "total_errors": 6, "false_positive": 1, "false_negative": 1, "false_neutral": 2,
                   "missed_neutral": 2, "low_confidence": 2, "error_rate": 75.0}


def test_reports_run(spark):
    df = table(spark, [("A", "Positive", "2020-01", 30), ("A", "Negative", "2020-02", 25), ("B", "Neutral", "2020-02", 40)])
    f = Filters(label_source="predicted", aspects=["A"])
    assert reports.aspects(df, f).count() == 1
    for tables in (reports.meta(df), reports.overview(df, f), reports.aspect_pulse(df, f), reports.trend_tables(df, f),
                   reports.performance(df, f), reports.business(df, f), reports.error_analysis(df, f),
                   reports.aspect_detail(df, "A")):
        for frame in tables.values():
            frame.collect()
    assert reports.voice(df, f).first()["ngram"] in ("clean train", "nice clean")
    assert reports.word_cloud(df, "positive").count() == 3
    assert reports.aspect_reviews(df, "A").count() == 16
    assert reports.cards(df).count() == 0
    assert reports.kpi_strip(df, f).first()["rows"] == 55

"""What the physical plans must and must not contain."""

import pytest

from checks import CHECKS, spark_query
from tonecast.operators.filters import Filters, apply_filters

# these run Python inside tasks by design
PYTHON = {"cosine_topk", "cosine_topk_blocked", "cosine_topk_indexed", "retrieved_chunks", "question_sources", "context_text", "tfidf_weights", "tfidf_raw_counts", "ngrams_summarised", "vocabulary_summarised",
          "score_reviews", "predict_view", "token_attribution", "oversample", "model_state", "saved_model"}
FITTED = {"score_reviews", "saved_model", "model_state", "predict_view", "token_attribution", "oversample", "lda_topics", "tfidf_weights", "tfidf_raw_counts"}


@pytest.mark.parametrize("name", [n for n in CHECKS if n not in FITTED])
def test_no_python_and_no_product(name, spark, sf_dir):
    plan = spark_query(name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("A", "web", "Positive", 0.5)], "aspect string, source string, sentiment string, sentiment_confidence double") \
        .selectExpr("*", "timestamp'2020-01-01' as created_at_date", "'unused' as extra").write.parquet(path)
    df = apply_filters(spark.read.parquet(path), Filters("2020-01-01", "2020-12-31", ["A"], ["web"], min_confidence=0.1))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = df.select("sentiment")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("GreaterThanOrEqual(created_at_date", "LessThanOrEqual(created_at_date", "EqualTo(aspect,A)",
                 "GreaterThanOrEqual(sentiment_confidence"):
        assert part in pushed
    assert "extra" not in plan


@pytest.mark.parametrize("name,scans", [("kpis", 1), ("nss_cuts_grouping_sets", 1), ("exec_summary", 1), ("source_breakdown", 1),
                                        ("quadrant", 1), ("insight_cards", 1), ("trend_by_aspect", 1), ("class_report", 1)])
def test_number_of_passes(name, scans, spark, sf_dir):
    plan = spark_query(name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == scans

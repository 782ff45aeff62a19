"""Sinks and readers: the given tables written in each format, read back through the library and compared whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import label_queries, tally_queries  # noqa: F401  (their statements are the results to read back)
from checks.model_queries import _model
from checks.registry import CHECKS, check
from tonecast.operators import classifier, cleaning, evaluation, tallies
from tonecast.schema import CLEANED_COLUMNS, RAW_COLUMNS
from tonecast.session import shared_dir
from tonecast.sources import readers, writers

_REST = [c for c in RAW_COLUMNS if c != "review_text"]


def _folder(v, name):
    return f"{shared_dir(v.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _csv(v, df, name):
    path = _folder(v, name)
    writers.write_csv(df, path)
    return path


@check("csv_raw", views="raw", sql=f"SELECT review_id, md5(review_text) AS text_md5, {', '.join(_REST)} FROM raw")
def csv_raw(v):
    """Whole texts with their line breaks, quotes and blanks at either end."""
    path = _csv(v, v.raw.select("review_id", *RAW_COLUMNS), "raw")
    return readers.read_raw(v.spark, path).select("review_id", F.md5("review_text").alias("text_md5"), *_REST)


@check("csv_cleaned", CHECKS["prepare_cleaned"].sql)
def csv_cleaned(v):
    path = _csv(v, v.raw.select("review_id", *CLEANED_COLUMNS), "cleaned")
    return readers.read_cleaned(v.spark, path).select("review_id", "aspect", "sentiment", "text_id")


@check("csv_scored", views="scored", sql="""SELECT review_id, md5(review_text) AS text_md5, review_rating, source, aspect_pred, sentiment_pred,
  sentiment_confidence, year_month, year, month, date FROM scored""")
def csv_scored(v):
    columns = ["review_id", *RAW_COLUMNS, "aspect_pred", "sentiment_pred", "sentiment_confidence"]
    path = _csv(v, v.scored.select(*columns), "scored")
    table = readers.read_dashboard(v.spark, path)
    return table.select("review_id", F.md5("review_text").alias("text_md5"), "review_rating", "source", "aspect_pred",
                        "sentiment_pred", "sentiment_confidence", "year_month", "year", "month", "date")


@check("text_lines", views="texts", sql=r"""SELECT md5(line) AS line_md5, count(*) AS "rows" FROM (
  SELECT trim(regexp_replace(unnest(string_split_regex(review_text, '\r\n|\r|\n')), '^\s+|\s+$', '', 'g')) AS line FROM texts)
  WHERE line <> '' GROUP BY line""")
def text_lines(v):
    path = _folder(v, "lines")
    v.texts.where("review_text IS NOT NULL").select("review_text").write.text(path)
    lines = readers.read_lines(v.spark, path)
    return lines.groupBy(F.md5("review_text").alias("line_md5")).agg(F.count("*").alias("rows"))


@check("json_metrics", CHECKS["class_report"].sql)
def json_metrics(v):
    report, path = evaluation.class_report(v.reviews), _folder(v, "metrics")
    writers.write_json(report, path)
    return v.spark.read.schema(report.schema).json(path)


@check("nss_text", views="reviews", ctes="g AS (SELECT count(*) AS n, 100.0 * (count(*) FILTER (WHERE sentiment = 'Positive') - "
       "count(*) FILTER (WHERE sentiment = 'Negative')) / count(*) AS nss FROM reviews)",
       sql="SELECT 'rows=' || n AS line FROM g UNION ALL SELECT 'NSS=' || printf('%.2f', nss) FROM g")
def nss_text(v):
    path = _folder(v, "nss")
    writers.write_nss_text(tallies.nss_overall(v.reviews), path)
    return readers.read_lines(v.spark, path).withColumnRenamed("review_text", "line")


@check("saved_model", views="texts", sql="SELECT review_id, true AS same_label, true AS same_confidence FROM texts")
def saved_model(v):
    """A saved and loaded model scores every text as the fitted one does."""
    path, fitted = _folder(v, "model"), _model(v)
    fitted.save(path)
    rows = cleaning.with_rule_aspect(v.texts, batched=True)
    again = classifier.SentimentModel.load(path).transform(rows, "aspect_pred").select(
        "review_id", F.col("sentiment_pred").alias("label"), F.col("sentiment_confidence").alias("confidence"))
    return fitted.transform(rows, "aspect_pred").join(again, "review_id").select(
        "review_id", F.col("sentiment_pred").eqNullSafe(F.col("label")).alias("same_label"),
        F.col("sentiment_confidence").eqNullSafe(F.col("confidence")).alias("same_confidence"))

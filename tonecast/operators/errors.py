"""Error types of the sentiment model: always labels against predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonecast.functions import expressions as ex
from tonecast.operators import scaling

LOW_CONFIDENCE = 0.6


def _types(low_confidence: float = LOW_CONFIDENCE) -> dict[str, Column]:
    t, p, neutral = F.col("sentiment"), F.col("sentiment_pred"), F.lit("Neutral")
    return {
        "false_positive": (t == "Negative") & (p == "Positive"),
        "false_negative": (t == "Positive") & (p == "Negative"),
        "false_neutral": ~t.eqNullSafe(neutral) & p.eqNullSafe(neutral),
        "missed_neutral": t.eqNullSafe(neutral) & ~p.eqNullSafe(neutral),
        "low_confidence": _wrong() & (F.col("sentiment_confidence") < low_confidence),
    }


def _wrong() -> Column:
    """Label and prediction differ; a missing label is a value of its own here."""
    return ~F.col("sentiment").eqNullSafe(F.col("sentiment_pred"))


def error_summary(df: DataFrame, low_confidence: float = LOW_CONFIDENCE) -> DataFrame:
    """Totals, error rate and count of every error type in one aggregate."""
    wrong = F.count_if(_wrong())
    t = df.agg(F.count(F.lit(1)).alias("total"), wrong.alias("total_errors"),
               *[F.count_if(c).alias(name) for name, c in _types(low_confidence).items()])
    return t.withColumn("error_rate", ex.share(F.col("total_errors"), F.col("total")))


def error_type_counts(df: DataFrame, low_confidence: float = LOW_CONFIDENCE) -> DataFrame:
    """The same counts as long rows."""
    names = list(_types())
    cells = F.array(*[F.struct(F.lit(n).alias("error_type"), F.col(n).alias("rows")) for n in names])
    return error_summary(df, low_confidence).select(F.inline(cells))


def errors_by(df: DataFrame, key: str = "aspect", min_rows: int = 20) -> DataFrame:
    """Error rates per aspect with enough rows, highest first."""
    kinds = _types()
    wrong = F.count_if(_wrong())
    t = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("aspect")).agg(
        F.count(F.lit(1)).alias("rows"), wrong.alias("errors"),
        F.count_if(kinds["false_positive"]).alias("fp"), F.count_if(kinds["false_negative"]).alias("fn"),
        F.count_if(kinds["false_neutral"]).alias("false_neutral"))
    return (t.filter(F.col("rows") >= min_rows)
            .withColumn("error_rate", ex.share(F.col("errors"), F.col("rows")))
            .orderBy(F.desc("error_rate"), "aspect"))


def error_samples(df: DataFrame, k: int = 8, seed: int = 42, key: str = "review_id",
                  low_confidence: float = LOW_CONFIDENCE) -> DataFrame:
    """Up to ``k`` repeatable sample rows per error type; a row may illustrate several types."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in _types(low_confidence).items()]))
    rows = df.withColumn("error_type", F.explode(found)).withColumn("_h", ex.seeded_hash(seed, F.col(key)))
    return scaling.first_per_group(rows, ["error_type"], [F.asc("_h"), F.asc(key)], k).drop("_h")


def sample_view(df: DataFrame, *extra: str) -> DataFrame:
    """Display form of sampled rows: shortened text, defaults for missing values, date without time."""
    return df.select(*extra, ex.preview(F.col("review_text"), 350).alias("text"),
                     F.coalesce(F.col("review_rating"), F.lit(0)).alias("rating"),
                     F.coalesce(F.col("source"), F.lit("")).alias("source"), "sentiment",
                     F.substring(F.col("created_at_date").cast("string"), 1, 10).alias("date"), "aspect",
                     F.col("sentiment_pred").alias("predicted"),
                     F.bround("sentiment_confidence", 3).alias("confidence"))


def first_errors(df: DataFrame, n: int = 30, key: str = "review_id", true: str = "sentiment",
                 pred: str = "sentiment_pred") -> DataFrame:
    """First ``n`` misclassified rows in key order with a short text preview."""
    wrong = df.filter(ex.differs(F.col(true), F.col(pred)))
    return wrong.orderBy(key).limit(n).select(key, "aspect", F.col(true).alias("y_true"), F.col(pred).alias("y_pred"),
                                              ex.preview(F.col("review_text"), 180).alias("text_preview"))

"""Column contracts of the review tables: names and order are fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

SENTIMENTS = ["Negative", "Neutral", "Positive"]

RAW_COLUMNS = [
    "review_text", "review_rating", "source", "created_at_date",
    "bts_line", "reviewer_hometown", "aspect", "sentiment",
]
CLEANED_COLUMNS = ["review_text", "review_rating", "aspect", "sentiment"]
PREDICTION_COLUMNS = ["aspect_pred", "sentiment_pred", "sentiment_confidence"]
SCORED_COLUMNS = RAW_COLUMNS + PREDICTION_COLUMNS

_TYPES = {"review_rating": T.IntegerType(), "sentiment_confidence": T.DoubleType()}


def review_schema(columns: list[str]) -> T.StructType:
    """Explicit schema for a list of review columns (no inference pass over the data)."""
    return T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in columns])


def require_columns(present: list[str], needed: list[str]) -> None:
    missing = sorted(set(needed) - set(present))
    if missing:
        raise ValueError(f"the review table lacks {', '.join(missing)}")

#: Retrieval documents and their metadata.
DOCUMENT_SCHEMA = "id string, document string, sentiment string, source string, date string, rating int, aspect string"

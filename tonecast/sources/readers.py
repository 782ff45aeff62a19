"""Review table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonecast.functions import expressions as ex
from tonecast.operators import cleaning
from tonecast.schema import CLEANED_COLUMNS, RAW_COLUMNS, require_columns, review_schema

_CSV = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False}


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV; only the first record is read."""
    return spark.read.options(**{**_CSV, "enforceSchema": True}).csv(path).columns


def read_csv(spark: SparkSession, path: str, required: list[str] = (), line_breaks: bool = True) -> DataFrame:
    """CSV read under an explicit schema in the file's column order.

    Files whose quoted fields hold line breaks are one task each; without such breaks (``line_breaks=False``) large
    files are split. ``jobs.prepare_dashboard`` converts a file once.
    """
    header = csv_header(spark, path)
    require_columns(header, list(required))
    schema = review_schema(header)
    return spark.read.schema(schema).options(**{**_CSV, "multiLine": line_breaks}).csv(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RAW_COLUMNS)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned reviews: column check, label check, text ids."""
    return cleaning.prepare_cleaned(read_csv(spark, path, CLEANED_COLUMNS))


def read_dashboard(spark: SparkSession, path: str, parquet: bool = False) -> DataFrame:
    """Scored reviews with parsed dates, calendar and length columns."""
    df = spark.read.parquet(path) if parquet else read_csv(spark, path)
    return cleaning.dashboard_table(df)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """The dashboard table as ``jobs.prepare_dashboard`` wrote it; filters on year prune folders, those on dates reach the files."""
    return spark.read.parquet(path).drop("month_of")


def read_pairs(df: DataFrame) -> DataFrame:
    """Complete (text, aspect) pairs; the scan reads just these two columns."""
    return df.select("review_text", "aspect").na.drop()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One review per line, trimmed, blank lines dropped."""
    return (spark.read.text(path).select(ex.strip(F.col("value")).alias("review_text"))
            .filter(F.col("review_text") != ""))

"""Sinks for tables, metrics and single values. Every sink writes a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV that ``readers.read_csv`` gives back as it was: blanks at either end of a field stay, null and empty come back as null."""
    df.write.mode(mode).options(**_CSV).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: str | list[str] | None = None, mode: str = "errorifexists",
                  overwrite_parts: bool = False) -> None:
    """Parquet, by default unpartitioned. With ``overwrite_parts`` and mode overwrite only partitions that ``df`` has are replaced."""
    writer = df.write.mode(mode)
    if overwrite_parts:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    columns = [partition_by] if isinstance(partition_by, str) else partition_by or []
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_nss_text(overall: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Two text lines with row count and score of a one-row table (rows, nss)."""
    line = F.format_string("rows=%d\nNSS=%.2f", F.col("rows"), F.bround("nss", 2))
    overall.select(line.alias("value")).write.mode(mode).text(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table, on any file system Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

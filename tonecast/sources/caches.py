"""Keyed tables that grow by what is missing: prediction cache and document collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.operators import scaling
from tonecast.session import materialize


def distinct_by_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the smallest by value, so repeated runs agree."""
    rest = [c for c in df.columns if c != key]
    row = F.min(F.struct(*rest)).alias("_r")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, "_r.*")


def attach_cached(df: DataFrame, cache: DataFrame, key: str = "text_id", value: str = "aspect_pred") -> DataFrame:
    """Left join with the cached value; copies of a frequent text are spread over tasks."""
    return scaling.join_hot_keys(df, distinct_by_key(cache.select(key, value), key), key, "left")


def missing_from(df: DataFrame, cache: DataFrame, key: str = "text_id") -> DataFrame:
    """Rows whose key the cache lacks."""
    return scaling.join_hot_keys(df, cache.select(key).distinct(), key, "left_anti")


def union_previous_first(previous: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed union in which rows already present win."""
    old = distinct_by_key(previous, key)
    fresh = distinct_by_key(new.select(*previous.columns), key).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh)


def complete_cache(df: DataFrame, cache: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: str = "text_id",
                   value: str = "aspect_pred") -> tuple[DataFrame, DataFrame]:
    """Score only the texts the cache lacks: (rows with the value, grown cache).

    Each missing text is scored once, however often it occurs.
    """
    needed = distinct_by_key(missing_from(df, cache, key).select(key, "review_text"), key)
    scored = scorer(needed).select(key, value).filter(F.col(value).isNotNull())
    grown = union_previous_first(cache.select(key, value), scored, key)
    return attach_cached(df, grown, key, value), grown


def merge_documents(collection: DataFrame, new: DataFrame, force: bool = False, key: str = "id") -> DataFrame:
    """Seed a document collection once: untouched when it has rows, unless ``force`` upserts the new ones."""
    if not force and not collection.isEmpty():
        return collection
    kept = collection.join(new.select(key), key, "left_anti")
    return kept.unionByName(new)


BUCKETS = 64


def write_bucketed(cache: DataFrame, table: str, key: str = "text_id", buckets: int = BUCKETS) -> DataFrame:
    """The cache, one row per key, as a table bucketed and sorted by key in the warehouse; joins read it without a shuffle."""
    rows = distinct_by_key(cache, key).repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("errorifexists").saveAsTable(table)
    return cache.sparkSession.table(table)


def complete_bucketed(df: DataFrame, table: str, scorer: Callable[[DataFrame], DataFrame], key: str = "text_id",
                      value: str = "aspect_pred") -> DataFrame:
    """Rows with the cached value, after appending to the bucketed table what it lacked: new keys only are written.

    Keys of the rows are reduced to distinct ones and meet the table bucket by bucket, so the table is neither shuffled
    nor rewritten. Rows of a frequent text are spread when the value is attached.
    """
    spark = df.sparkSession
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").first()["data_type"])
    texts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("review_text").alias("review_text"))
    needed = texts.repartition(buckets, key).join(spark.table(table).select(key), key, "left_anti")
    fresh = materialize(scorer(needed).select(key, value).filter(F.col(value).isNotNull()), "scored")
    if not fresh.isEmpty():
        fresh.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("append").saveAsTable(table)
    values = texts.select(key).repartition(buckets, key).join(spark.table(table), key).select(key, value)
    return scaling.join_hot_keys(df, values, key, "left")

"""Trend direction between the earlier and the later half of the months with data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonecast.functions import expressions as ex

TREND_CUT = 5.0


def direction(delta: Column, cut: float = TREND_CUT) -> Column:
    return F.when(delta > cut, "improving").when(delta < -cut, "declining").otherwise("stable")


def movement(df: DataFrame, group: str | None = None, sentiment: str = "sentiment",
             round_first: bool = False) -> DataFrame:
    """Totals and trend per ``group`` (or overall) from one aggregate by month.

    NSS of both halves is pooled over rows; the first ``floor(n/2)`` months with data are the prior half.
    One month alone is stable with equal scores. ``round_first`` compares scores already rounded to one
    place. Rows shrink to months per group before the window, so ranking handles a calendar, not reviews.
    """
    key = F.col(group) if group else F.lit("all")
    s = F.col(sentiment)
    months = (df.filter(key.isNotNull()).groupBy(key.alias("g"), "year_month")
              .agg(F.count(F.lit(1)).alias("rows"), ex.is_label(s, "Positive").alias("pos"),
                   ex.is_label(s, "Negative").alias("neg"), ex.is_label(s, "Neutral").alias("neu")))
    # rows without a month count in the totals only
    known = F.col("year_month").isNotNull()
    ordered = Window.partitionBy("g").orderBy(F.asc_nulls_last("year_month"))
    ranked = months.withColumns({"i": F.row_number().over(ordered), "known": known,
                                 "n": F.count("year_month").over(Window.partitionBy("g"))})
    half = F.floor(F.col("n") / 2)
    parts = {"e": F.col("known") & (F.col("i") <= half), "l": F.col("known") & (F.col("i") > half)}
    sums = [F.coalesce(F.sum(F.when(condition, F.col(c))), F.lit(0)).alias(f"{name}_{c}")
            for name, condition in parts.items() for c in ("pos", "neg", "rows")]
    t = ranked.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("rows", "pos", "neg", "neu")], *sums,
                                F.max("n").alias("months"))

    def half_nss(name: str) -> Column:
        value = ex.nss(F.col(f"{name}_pos"), F.col(f"{name}_neg"), F.col(f"{name}_rows"))
        return F.bround(value, 1) if round_first else value

    recent = half_nss("l")
    # only the later half exists when there is a single month
    prior = half_nss("e") if round_first else F.when(F.col("months") < 2, recent).otherwise(half_nss("e"))
    out = t.select(F.col("g").alias(group or "scope"), "rows", "pos", "neg", "neu", "months",
                   recent.alias("recent_nss"), prior.alias("prior_nss"))
    delta = F.col("recent_nss") - F.col("prior_nss")
    out = out.withColumn("delta", F.bround(delta, 1) if round_first else delta)
    return out.withColumn("direction", direction(F.col("delta")))


def trend(df: DataFrame, group: str | None = None, sentiment: str = "sentiment", round_first: bool = False) -> DataFrame:
    """Trend columns of ``movement``."""
    return movement(df, group, sentiment, round_first).drop("rows", "pos", "neg", "neu")

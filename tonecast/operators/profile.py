"""Data profile: missing values, descriptive statistics, lengths, summary record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tonecast.functions import expressions as ex
from tonecast.functions import tokens as tk
from tonecast.operators import quantiles
from tonecast.session import materialize


def missing_profile(df: DataFrame) -> DataFrame:
    """Null count and percentage per column, in one aggregate."""
    t = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"),
                               ex.share(F.col(c), F.col("_rows")).alias("pct")) for c in df.columns])
    return t.select(F.inline(cells))


def describe_all(df: DataFrame) -> DataFrame:
    """Per column: non-null rows, distinct values, most frequent value and, for numbers, mean, deviation and quartiles.

    Moments take one aggregate, quartiles the passes of ``quantiles``, distinct and most frequent values two levels of
    counting by digest (``_modes``); a tie for the most frequent goes to the smaller text. The result has one row per
    column, whose numbers pass through the driver.
    """
    spark, numeric = df.sparkSession, [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    measures = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    told = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)],
                  *[f(F.col(c).cast("double")).alias(f"{m}{i}") for i, c in enumerate(numeric) for m, f in measures.items()]).first()
    q = quantiles.exact(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    modes = {r["column"]: r for r in _modes(df).collect()}
    rows = []
    for i, c in enumerate(df.columns):
        if not told[f"n{i}"]:
            continue
        k = numeric.index(c) if c in numeric else None
        own = {m: None if k is None else told[f"{m}{k}"] for m in measures}
        rows.append((c, told[f"n{i}"], modes[c]["n_distinct"], modes[c]["top"], modes[c]["freq"], own["mean"], own["std"], own["min"],
                     *(q.get((c, p)) for p in (0.25, 0.5, 0.75)), own["max"]))
    return spark.createDataFrame(rows, "column string, n long, n_distinct long, top string, freq long, mean double, std double, "
                                       "min double, q1 double, median double, q3 double, max double")


_HEAD = 32  # leading characters of a text that travel with its digest


def _modes(df: DataFrame) -> DataFrame:
    """Per column with values: n_distinct, the most frequent text (the smallest of a tie) and its freq.

    Texts are counted by digest, so no task holds a column's values and no whole text is shuffled; the rest are plain
    aggregates over the counts, which nothing sorts. Where the winners share a longer head, a second pass takes the smallest text among them.
    """
    def cells(of: DataFrame, columns: list[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns])
        return of.select(F.inline(each)).filter(F.col("text").isNotNull()).select(
            "column", "text", F.unhex(F.md5("text")).alias("digest"), F.substring("text", 1, _HEAD).alias("head"))
    # the head follows from the digest; as a key it leaves a count of fixed size, which is hashed and not sorted
    per = materialize(cells(df, df.columns).groupBy("column", "digest", "head").agg(F.count(F.lit(1)).alias("w")), "digests")
    own = [F.col("column") == c for c in df.columns]
    told = per.agg(*[m.alias(f"{n}{i}") for i, c in enumerate(own) for n, m in (("n", F.count_if(c)), ("w", F.max(F.when(c, F.col("w")))))]).first()
    heads = per.agg(*[F.min(F.when(c & (F.col("w") == told[f"w{i}"]), F.col("head"))).alias(f"h{i}") for i, c in enumerate(own)]).first()
    won = df.sparkSession.createDataFrame(
        [(c, told[f"n{i}"], told[f"w{i}"], heads[f"h{i}"]) for i, c in enumerate(df.columns) if told[f"n{i}"]],
        "column string, n_distinct long, w long, head string")  # one row per column
    long = [r["column"] for r in won.filter(F.length("head") == _HEAD).collect()]
    if not long:
        return won.select("column", "n_distinct", F.col("head").alias("top"), F.col("w").alias("freq"))
    tied = per.join(F.broadcast(won.select("column", "w", "head")), ["column", "w", "head"], "left_semi").select("column", "digest")
    # only texts with the head of a winner are looked at
    near = cells(df, long).join(F.broadcast(won.select("column", "head")), ["column", "head"], "left_semi")
    tops = near.join(tied, ["column", "digest"], "left_semi").groupBy("column").agg(F.min("text").alias("top"))
    return won.join(tops, "column", "left").select("column", "n_distinct", F.coalesce("top", "head").alias("top"), F.col("w").alias("freq"))


def length_stats(df: DataFrame, group: str | None = None) -> DataFrame:
    """Mean, deviation and exact quartiles of text length and word count, overall or per group."""
    measures = ["text_length", "word_count"]
    keys = [group] if group else []
    source = df.filter(F.col(group).isNotNull()) if group else df
    long = source.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("v")) for m in measures])))
    # equal lengths are merged first: quartiles then work on distinct values with frequencies
    distinct = long.groupBy(*keys, "measure", "v").agg(F.count(F.lit(1)).alias("w"))
    v, w = F.col("v"), F.col("w")
    total, mean = F.sum("w"), F.sum(v * w) / F.sum("w")
    variance = (F.sum(v * v * w) - F.sum(v * w) * F.sum(v * w) / F.sum("w")) / F.nullif(F.sum("w") - 1, F.lit(0))
    quartiles = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("w"))
    t = distinct.groupBy(*keys, "measure").agg(
        total.alias("n"), mean.alias("mean"), F.sqrt(variance).alias("std"), F.min("v").alias("min"),
        quartiles.alias("q"), F.max("v").alias("max"))
    return t.select(*keys, "measure", "n", "mean", "std", "min", F.col("q")[0].alias("q1"),
                    F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def histogram(df: DataFrame, column: str, clip: int, bins: int = 50) -> DataFrame:
    """Equal-width histogram between the observed bounds after clipping; the last bin is closed."""
    values = df.select(F.least(F.col(column), F.lit(clip)).cast("long").alias("v")).groupBy("v").count()
    whole = Window.partitionBy(F.lit(0))  # clipping leaves at most ``clip`` + 1 distinct values
    values = values.withColumns({"low": F.min("v").over(whole), "high": F.max("v").over(whole)})
    low, high = F.col("low"), F.col("high")
    # a single value spreads over [v - 0.5, v + 0.5]
    flat = high == low
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low) / bins
    position = F.least(F.floor((F.col("v") - start) / width), F.lit(bins - 1)).cast("int")
    t = values.groupBy(position.alias("bin")).agg(F.sum("count").alias("rows"), F.min(start).alias("start"),
                                                  F.min(width).alias("width"))
    return t.select("bin", "rows", (F.col("start") + F.col("bin") * F.col("width")).alias("lower"),
                    (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("upper"))


def summary_record(df: DataFrame) -> DataFrame:
    """One wide row: volumes, shares, NSS, length means and medians, vocabulary, date range, value lists.

    Expects calendar and length columns. Exact medians keep one counter per distinct length; value lists
    hold the small source and line domains.
    """
    s = F.col("sentiment")
    base = df.agg(
        F.count(F.lit(1)).alias("rows"), ex.is_label(s, "Positive").alias("pos"), ex.is_label(s, "Negative").alias("neg"),
        F.avg("text_length").alias("avg_length"), F.percentile("text_length", F.lit(0.5)).alias("median_length"),
        F.avg("word_count").alias("avg_words"), F.percentile("word_count", F.lit(0.5)).alias("median_words"),
        F.date_format(F.min("created_at_date"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("created_at_date"), "yyyy-MM-dd").alias("date_max"),
        F.count_distinct("aspect").alias("n_aspects"),
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("bts_line")), ", ").alias("bts_lines"))
    words = df.select(F.explode(tk.words(F.col("review_text"))).alias("w")).groupBy("w").count()
    vocabulary = words.agg(F.struct(F.coalesce(F.sum("count"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("v")).alias("x"))
    vocabulary = vocabulary.scalar()
    return base.select(
        "rows", "pos", "neg", ex.share(F.col("pos"), F.col("rows")).alias("pct_positive"),
        ex.share(F.col("neg"), F.col("rows")).alias("pct_negative"),
        ex.nss(F.col("pos"), F.col("neg"), F.col("rows")).alias("nss"), "avg_length",
        "median_length", "avg_words", "median_words", vocabulary.getField("v").alias("vocabulary"),
        vocabulary.getField("t").alias("tokens"),
        "date_min", "date_max", "sources", "bts_lines", "n_aspects")

"""Net sentiment tables, indicators, counts and crosstabs.

Grouped tables drop rows whose key is null, while shares of a total still count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonecast.functions import expressions as ex
from tonecast.schema import SENTIMENTS


def counts(sentiment: str) -> list[Column]:
    s = F.col(sentiment)
    return [F.count(F.lit(1)).alias("rows"), ex.is_label(s, "Positive").alias("pos"),
            ex.is_label(s, "Negative").alias("neg"), ex.is_label(s, "Neutral").alias("neu")]


def score(df: DataFrame) -> DataFrame:
    """Add ``nss`` and ``pct_negative`` to a table of counts."""
    return df.withColumns({
        "nss": ex.nss(F.col("pos"), F.col("neg"), F.col("rows")),
        "pct_negative": ex.share(F.col("neg"), F.col("rows")),
    })


def nss_table(df: DataFrame, *keys: str, sentiment: str = "sentiment", min_rows: int = 0) -> DataFrame:
    """Counts, NSS and negative share per key combination."""
    present = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    grouped = present.groupBy(*keys).agg(*counts(sentiment))
    if min_rows:
        grouped = grouped.filter(F.col("rows") >= min_rows)
    return score(grouped)


def nss_overall(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    return score(df.agg(*counts(sentiment)))


def nss_by_aspect(df: DataFrame, aspect: str = "aspect", sentiment: str = "sentiment") -> DataFrame:
    """Aspect table, worst score first."""
    return nss_table(df.withColumn("aspect", F.col(aspect)), "aspect", sentiment=sentiment).orderBy("nss", "aspect")


def nss_cuts(df: DataFrame, aspect: str = "aspect", sentiment: str = "sentiment") -> DataFrame:
    """All standard cuts in one scan: aspect, source, line, year, month and the total.

    Rows: ``cut`` (which column), ``key`` (its value as text), counts, NSS. Null keys of a cut are left out.
    """
    cuts = [aspect, "source", "bts_line", "year", "year_month"]
    sets = [[F.col(c)] for c in cuts] + [[]]
    # reviews are counted once; the sets only copy the rows of this small table
    small = df.groupBy(*cuts).agg(*counts(sentiment))
    grouped = small.groupingSets(sets, *[F.col(c) for c in cuts]).agg(
        F.grouping_id().alias("g"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "pos", "neg", "neu")])
    # bit i of the grouping id is 0 for the one column that is grouped
    width = len(cuts)
    name, key = F.when(F.col("g") == 2 ** width - 1, "total"), F.lit("")
    for i, c in enumerate(cuts):
        used = F.col("g") == (2 ** width - 1) - 2 ** (width - 1 - i)
        name = name.when(used, "aspect" if c == aspect else c)
        key = F.when(used, F.col(c).cast("string")).otherwise(key)
    return score(grouped.select(name.alias("cut"), key.alias("key"), "rows", "pos", "neg", "neu")
                 .filter(F.col("key").isNotNull()))


def kpis(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """One row of headline indicators in a single pass; ``n_aspects`` always counts labelled aspects."""
    # distinct values are counted on one row per aspect and source
    small = df.groupBy("aspect", "source").agg(
        *counts(sentiment), F.min("created_at_date").alias("date_min"), F.max("created_at_date").alias("date_max"),
        F.sum("sentiment_confidence").alias("confidence"), F.count("sentiment_confidence").alias("rated"))
    t = small.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "pos", "neg", "neu")],
                  F.count_distinct("aspect").alias("n_aspects"), F.count_distinct("source").alias("n_sources"),
                  F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"),
                  F.coalesce(F.sum("confidence") / F.nullif(F.sum("rated"), F.lit(0)), F.lit(0.0)).alias("avg_confidence"))
    rows = F.col("rows")
    return t.select("rows", ex.nss(F.col("pos"), F.col("neg"), rows).alias("nss"),
                    ex.share(F.col("pos"), rows).alias("pct_positive"),
                    ex.share(F.col("neu"), rows).alias("pct_neutral"),
                    ex.share(F.col("neg"), rows).alias("pct_negative"),
                    "n_aspects", "n_sources",
                    F.date_format("date_min", "yyyy-MM-dd").alias("date_min"),
                    F.date_format("date_max", "yyyy-MM-dd").alias("date_max"), "avg_confidence")


def kpi_delta(df: DataFrame, condition: Column, sentiment: str = "sentiment") -> DataFrame:
    """Filtered against unfiltered indicators in one scan.

    ``rows_delta`` is null when nothing changed, ``nss_delta`` unless it moved by more than 0.1.
    """
    s, hit = F.col(sentiment), F.coalesce(condition, F.lit(False))
    t = df.agg(F.count(F.lit(1)).alias("base_rows"), ex.is_label(s, "Positive").alias("bp"),
               ex.is_label(s, "Negative").alias("bn"), F.count_if(hit).alias("rows"),
               F.count_if(hit & (s == "Positive")).alias("p"), F.count_if(hit & (s == "Negative")).alias("n"))
    t = t.select("rows", "base_rows", ex.nss(F.col("p"), F.col("n"), F.col("rows")).alias("nss"),
                 ex.nss(F.col("bp"), F.col("bn"), F.col("base_rows")).alias("base_nss"))
    return t.withColumns({
        "rows_delta": F.when(F.col("rows") != F.col("base_rows"), F.col("rows") - F.col("base_rows")),
        "nss_delta": F.when(F.abs(F.col("nss") - F.col("base_nss")) > 0.1, F.col("nss") - F.col("base_nss")),
    })


def breakdown(df: DataFrame, key: str, sentiment: str = "sentiment", top: int | None = None) -> DataFrame:
    """Rows, NSS and share of all rows per value, largest first; null values only count in the total.

    The total is a grouping set of the same pass: one row that the shares are taken of.
    """
    both = df.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping_id().alias("_g"), *counts(sentiment))
    total = F.max(F.when(F.col("_g") == 1, F.col("rows"))).over(Window.partitionBy(F.lit(0)))
    whole = both.withColumn("_total", total).filter((F.col("_g") == 0) & F.col(key).isNotNull())
    table = score(whole).select(key, "rows", "nss", (F.col("rows") / F.col("_total") * 100).alias("pct"))
    table = table.orderBy(F.desc("rows"), key)
    return table if top is None else table.limit(top)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    table = (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
             .orderBy(F.desc("rows"), column))
    return table.limit(top) if top else table


def fixed_counts(df: DataFrame, column: str, values: list) -> DataFrame:
    """Counts of the listed values in list order, with 0 for absent ones; one aggregate, no join."""
    t = df.agg(*[F.count_if(F.col(column) == v).alias(f"_{i}") for i, v in enumerate(values)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(v).alias(column), F.col(f"_{i}").alias("rows"))
                     for i, v in enumerate(values)])
    return t.select(F.inline(rows))


def crosstab(df: DataFrame, key: str, sentiment: str = "sentiment") -> DataFrame:
    """Counts of the three sentiments per key; the explicit label list spares a scan."""
    wide = (df.filter(F.col(key).isNotNull() & F.col(sentiment).isNotNull())
            .groupBy(key).agg(*[ex.is_label(F.col(sentiment), s).alias(s) for s in SENTIMENTS],
                              F.count(F.lit(1)).alias("total")))
    return wide


def crosstab_percent(df: DataFrame, key: str = "aspect", sentiment: str = "sentiment") -> DataFrame:
    """Crosstab with row percentages and the negative share ``neg_pct`` with its colour band."""
    wide = crosstab(df, key, sentiment)
    listed = F.greatest(sum((F.col(s) for s in SENTIMENTS), F.lit(0)), F.lit(1))
    out = wide.withColumns({f"pct_{s.lower()}": F.col(s) / listed * 100 for s in SENTIMENTS})
    out = out.withColumn("neg_pct", ex.share(F.col("Negative"), F.col("total")))
    return out.withColumn("band", ex.negative_band(F.col("neg_pct")))


def mean_negative_share(df: DataFrame, key: str = "aspect", sentiment: str = "sentiment") -> DataFrame:
    """Unweighted mean over keys of the negative share rounded to one place."""
    per_key = crosstab(df, key, sentiment).select(F.bround(ex.share(F.col("Negative"), F.col("total")), 1).alias("p"))
    return per_key.agg(F.avg("p").alias("mean_neg_pct"))


def seasonality(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows")).orderBy("year", "month")


def seasonality_wide(df: DataFrame) -> DataFrame:
    """One row per year with twelve month columns ``M01`` … ``M12``."""
    return df.groupBy("year").agg(*[F.count_if(F.col("month") == m).alias(f"M{m:02d}") for m in range(1, 13)]
                                  ).orderBy("year")


def monthly(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    return nss_table(df, "year_month", sentiment=sentiment).select("year_month", "rows", "nss").orderBy("year_month")


def aspect_month(df: DataFrame, aspect: str = "aspect", sentiment: str = "sentiment", min_rows: int = 5) -> DataFrame:
    return nss_table(df.withColumn("aspect", F.col(aspect)), "year_month", "aspect", sentiment=sentiment,
                     min_rows=min_rows).select("year_month", "aspect", "rows", "nss").orderBy("aspect", "year_month")


def latest_months(df: DataFrame, n: int, sentiment: str = "sentiment") -> DataFrame:
    """The ``n`` most recent months with data, newest first."""
    return monthly(df, sentiment).orderBy(F.desc("year_month")).limit(n)


def yearly(df: DataFrame, sentiment: str = "sentiment", min_rows: int = 0) -> DataFrame:
    return nss_table(df, "year", sentiment=sentiment, min_rows=min_rows).select(
        "year", "rows", "pos", "neg", "neu", "nss").orderBy("year")


def quadrant(df: DataFrame, aspect: str = "aspect", sentiment: str = "sentiment") -> DataFrame:
    """Volume against NSS per aspect with both median volumes: the interpolated and the upper one."""
    table = nss_table(df.withColumn("aspect", F.col(aspect)), "aspect", sentiment=sentiment)
    aspects = Window.partitionBy(F.lit(0))  # one row per aspect of a closed taxonomy
    ordered = F.array_sort(F.collect_list("rows").over(aspects))
    table = table.withColumns({"median_rows": F.percentile("rows", F.lit(0.5)).over(aspects), "_v": ordered})
    upper = F.element_at("_v", (F.floor(F.size("_v") / 2) + 1).cast("int"))
    return table.select("aspect", "rows", "nss", "median_rows", upper.alias("upper_median_rows"),
                        ex.nss_band(F.col("nss")).alias("band"))


def gauges(df: DataFrame, aspect: str = "aspect", sentiment: str = "sentiment") -> DataFrame:
    """Gauge position per aspect and bar length relative to the strongest score."""
    table = nss_table(df.withColumn("aspect", F.col(aspect)), "aspect", sentiment=sentiment)
    strongest = F.max(F.abs("nss")).over(Window.partitionBy(F.lit(1)))
    return table.select("aspect", "nss", ex.gauge(F.col("nss")).alias("gauge"),
                        (F.abs("nss") / F.greatest(strongest, F.lit(1.0))).alias("bar"))


def meta_values(df: DataFrame, aspect: str = "aspect") -> DataFrame:
    """Sorted distinct sources, lines and aspects as long rows, found in one scan."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
                      for kind, c in [("source", "source"), ("bts_line", "bts_line"), ("aspect", aspect)]])
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct().orderBy("kind", "value")


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.date_format(F.min("created_at_date"), "yyyy-MM-dd").alias("date_min"),
                  F.date_format(F.max("created_at_date"), "yyyy-MM-dd").alias("date_max"))

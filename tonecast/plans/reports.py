"""One function per analytic report; each takes the dashboard table and filters and returns DataFrames.

Report values are rounded for display; operators return them unrounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast import taxonomy as tx
from tonecast.operators import attribution, classifier, errors, evaluation, insights, phrases, retrieval, tallies, trends
from tonecast.operators.filters import Filters, apply_filters, predicate
from tonecast.session import materialize


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in columns})


def meta(df: DataFrame) -> dict[str, DataFrame]:
    return {"values": tallies.meta_values(df), "dates": tallies.date_bounds(df)}


def kpis(df: DataFrame, filters: Filters = Filters()) -> DataFrame:
    table = tallies.kpis(apply_filters(df, filters), filters.sentiment_col)
    table = _rounded(table, 2, "nss", "pct_positive", "pct_neutral", "pct_negative")
    empty = F.lit("")
    return _rounded(table, 4, "avg_confidence").withColumns(
        {"date_min": F.coalesce("date_min", empty), "date_max": F.coalesce("date_max", empty)})


def kpi_strip(df: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Filtered indicators with their change against the whole table."""
    return tallies.kpi_delta(df, predicate(df, filters), filters.sentiment_col)


def aspects(df: DataFrame, filters: Filters = Filters()) -> DataFrame:
    table = tallies.nss_by_aspect(apply_filters(df, filters), filters.aspect_col, filters.sentiment_col)
    return _rounded(table, 2, "nss", "pct_negative")


def overview(df: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    rows = apply_filters(df, filters)
    s = filters.sentiment_col
    return {"sentiments": tallies.fixed_counts(rows, s, ["Negative", "Neutral", "Positive"]),
            "rating_sentiment": tallies.crosstab(rows, "review_rating", s),
            "sources": tallies.value_counts(rows, "source", 10), "lines": tallies.value_counts(rows, "bts_line"),
            "cards": insights.insight_cards(rows, filters.aspect_col, s)}


def aspect_pulse(df: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    rows = apply_filters(df, filters)
    a, s = filters.aspect_col, filters.sentiment_col
    return {"table": tallies.nss_by_aspect(rows, a, s), "percent": tallies.crosstab_percent(rows, a, s),
            "quadrant": tallies.quadrant(rows, a, s), "gauges": tallies.gauges(rows, a, s)}


def trend_tables(df: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    rows = apply_filters(df, filters)
    s = filters.sentiment_col
    return {"monthly": _rounded(tallies.monthly(rows, s), 2, "nss"),
            "aspect_month": tallies.aspect_month(rows, filters.aspect_col, s),
            "seasonality": tallies.seasonality(rows), "seasonality_wide": tallies.seasonality_wide(rows)}


def voice(df: DataFrame, filters: Filters = Filters(), n: int = 20, max_texts: int | None = None) -> DataFrame:
    return phrases.voice(apply_filters(df, filters), n, filters.sentiment_col, max_texts=max_texts)


def word_cloud(df: DataFrame, polarity: str, filters: Filters = Filters(), max_texts: int | None = None) -> DataFrame:
    return phrases.cloud(apply_filters(df, filters), polarity, sentiment=filters.sentiment_col, max_texts=max_texts)


def performance(df: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    rows = apply_filters(df, filters)
    report = evaluation.class_report(rows)
    per_aspect = evaluation.quality_by(rows, "aspect").select("aspect", "rows", "accuracy", "macro_f1", "weighted_f1")
    overall = evaluation.averages(report).select(
        *[F.coalesce(F.bround(c, 4), F.lit(0.0)).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])
    return {
        "overall": overall,
        "confusion": _rounded(evaluation.confusion(rows), 4, "share"),
        "per_class": _rounded(report.drop("tp"), 4, "precision", "recall", "f1"),
        "calibration": _rounded(evaluation.calibration(rows), 4, "accuracy", "avg_conf").orderBy("bin"),
        "agreement": _rounded(evaluation.agreement(rows), 4, "agreement"),
        "aspect_confusion": _rounded(evaluation.union_confusion(rows), 4, "share"),
        "per_aspect": _rounded(per_aspect, 4, "accuracy", "macro_f1", "weighted_f1").orderBy(F.desc("weighted_f1"), "aspect"),
    }


def cards(df: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return insights.insight_cards(apply_filters(df, filters), filters.aspect_col, filters.sentiment_col).drop(
        "section", "position")


def business(df: DataFrame, filters: Filters = Filters(), max_texts: int | None = None) -> dict[str, DataFrame]:
    """Summary, aspect deep dives, leading sources and yearly scores."""
    rows = apply_filters(df, filters)
    a, s = filters.aspect_col, filters.sentiment_col
    dives = insights.deep_dives(rows, a, s, max_texts=max_texts)
    order = F.array_position(F.array(F.lit("urgent"), F.lit("monitor"), F.lit("leverage")), F.col("priority"))
    return {
        "summary": _rounded(insights.executive_summary(rows, a, s), 2, "overall_nss"),
        "deep_dives": _rounded(dives, 1, "nss", "pct_negative", "pct_positive", "recent_nss", "prior_nss", "delta")
        .orderBy(order, "nss", "aspect"),
        "sources": _rounded(tallies.breakdown(rows, "source", s, top=8), 1, "nss", "pct"),
        "yearly": _rounded(tallies.yearly(rows, s).select("year", "nss", "rows"), 1, "nss"),
    }


def error_analysis(df: DataFrame, filters: Filters = Filters(), k: int = 8, key: str = "review_id") -> dict[str, DataFrame]:
    rows = apply_filters(df, filters)
    return {
        "summary": _rounded(errors.error_summary(rows), 1, "error_rate"), "types": errors.error_type_counts(rows),
        "confusion": evaluation.confusion(rows).drop("share"),
        "samples": errors.sample_view(errors.error_samples(rows, k, key=key), "error_type", "rank"),
        "by_aspect": _rounded(errors.errors_by(rows, filters.aspect_col), 1, "error_rate").orderBy(
            F.desc("error_rate"), "aspect"),
    }


def aspect_reviews(df: DataFrame, aspect: str, filters: Filters = Filters(), k: int = 8, key: str = "review_id") -> DataFrame:
    rows = apply_filters(df, filters).filter(F.col(filters.aspect_col) == aspect)
    return retrieval.samples(rows, k, 400, filters.aspect_col, filters.sentiment_col, key=key)


def aspect_summaries(rows: DataFrame, aspect: str, sentiment: str, n_phrases: int = 6,
                     max_texts: int | None = None) -> DataFrame:
    """Detail record of every aspect: rounded score and shares, trend, priority from the rounded score, phrases."""
    base = rows.withColumn("aspect", F.col(aspect))
    table = tallies.score(trends.movement(base, "aspect", sentiment))
    n = F.col("rows")
    table = table.select("aspect", F.bround("nss", 1).alias("nss"), "rows",
                         F.bround(F.col("pos") / n * 100, 1).alias("pct_positive"),
                         F.bround(F.col("neu") / n * 100, 1).alias("pct_neutral"),
                         F.bround(F.col("neg") / n * 100, 1).alias("pct_negative"), "direction",
                         *[F.bround(c, 1).alias(c) for c in ("recent_nss", "prior_nss", "delta")])
    texts = insights.phrase_lists(base, "aspect", sentiment, n_phrases, "business", max_texts)
    out = table.join(texts, "aspect", "left").withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("top_complaints", "top_praises")})
    return out.select("*", insights.priority(F.col("nss"), n).alias("priority"),
                      insights.action(F.col("aspect")).alias("action"))


def aspect_detail(df: DataFrame, aspect: str, filters: Filters = Filters(), max_texts: int | None = None,
                  key: str = "review_id") -> dict[str, DataFrame]:
    """Everything about one aspect. Without matching rows the summary is a single zero record."""
    rows = apply_filters(df, filters).filter(F.col(filters.aspect_col) == aspect)
    a, s = filters.aspect_col, filters.sentiment_col
    found = aspect_summaries(rows, a, s, 6, max_texts)
    # a row rather than a literal, which would fold the join's condition away
    zero = df.sparkSession.createDataFrame([(aspect,)], "aspect string")
    default_action = insights.lookup(F.col("aspect"), tx.ACTIONS, F.lit(""))
    zeros = {"nss": 0.0, "rows": 0, "pct_positive": 0.0, "pct_neutral": 0.0, "pct_negative": 0.0, "direction": "stable",
             "recent_nss": 0.0, "prior_nss": 0.0, "delta": 0.0, "top_complaints": "", "top_praises": "",
             "priority": "monitor"}
    summary = zero.join(found, "aspect", "left").select(
        "aspect", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zeros.items()],
        F.coalesce("action", default_action).alias("action"))
    return {
        "summary": summary,
        "yearly": _rounded(tallies.yearly(rows, s, min_rows=20), 1, "nss"),
        "ratings": rows.filter(F.col("review_rating").isNotNull()).groupBy("review_rating")
        .agg(F.count(F.lit(1)).alias("rows")).orderBy("review_rating"),
        "sources": _rounded(tallies.breakdown(rows, "source", s, top=6), 1, "nss", "pct"),
        "samples": retrieval.samples(rows, 6, 350, a, s, key=key),
    }


def predict(df: DataFrame, model: classifier.SentimentModel) -> DataFrame:
    """Label, confidence and class probabilities to four places."""
    scored = model.transform(df)
    return scored.withColumns({c: F.bround(c, 4) for c in classifier.PROBABILITIES.values()})


def explain(df: DataFrame, model: classifier.SentimentModel, background: DataFrame, top_k: int = 15,
            key: str = "review_id") -> DataFrame:
    """Strongest tokens per review, by signed contribution; a review's rows share a partition and are sorted there."""
    mean = attribution.background_mean(background, model, key=key)
    rows = _rounded(attribution.explain(df, model, mean, top_k, key), 4, "value", "base_value")
    return rows.sortWithinPartitions(key, "value", "term")


def question_contexts(df: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Context text per question from retrieved chunks and aspect statistics."""
    return retrieval.context_text(questions, chunks, retrieval.statistics_text(retrieval.aspect_contexts(df)))


#: Columns that name a row of a composed report's tables; the others are its items.
TABLE_KEYS = {
    "confusion": ["true_label", "pred_label"], "aspect_confusion": ["true_label", "pred_label"], "per_class": ["label"],
    "calibration": ["bin"], "per_aspect": ["aspect"], "deep_dives": ["aspect"], "sources": ["source"], "lines": ["bts_line"],
    "yearly": ["year"], "types": ["error_type"], "samples": ["error_type", "rank"], "by_aspect": ["aspect"],
    "sentiments": ["sentiment"], "rating_sentiment": ["review_rating"], "cards": ["section", "position"],
}


def flat(tables: dict[str, DataFrame]) -> DataFrame:
    """A composed report as one table: section, key (values of the key columns), item and its number or text."""
    out = None
    for section, table in tables.items():
        keys = TABLE_KEYS.get(section, [])
        kinds = dict(table.dtypes)
        items = [F.struct(F.lit(c).alias("item"),
                          (F.lit(None).cast("double") if kinds[c] == "string" else F.col(c).cast("double")).alias("value"),
                          (F.col(c) if kinds[c] == "string" else F.lit(None).cast("string")).alias("text"))
                 for c in table.columns if c not in keys]
        rows = table.select(F.lit(section).alias("section"), F.concat_ws("|", *keys).alias("key"), F.inline(F.array(*items)))
        out = rows if out is None else out.unionByName(rows)
    return out


def composed(report: Callable[..., dict[str, DataFrame]], df: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    """The tables of a report over filtered rows that are written once, so the source is scanned once however many tables there are."""
    rows = materialize(apply_filters(df, filters), "report")
    return report(rows, Filters(label_source=filters.label_source))

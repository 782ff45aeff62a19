"""Queries on net sentiment, indicators, trends, insights."""

from pyspark.sql import functions as F

from checks.registry import COUNTS, NSS, check, pct, rounded
from checks.views import Views
from tonecast import taxonomy as tx
from tonecast.functions import expressions as ex
from tonecast.operators import cleaning, insights, profile, tallies, trends
from tonecast.operators.filters import Filters, apply_filters, predicate

FLAGSHIP = Filters(date_start="1995-01-01", date_end="1998-06-30", sources=[], min_confidence=0.4, end_of_day=True)
ALL = Filters(date_start="1995-01-01", date_end="1997-12-31", aspects=["ECONOMY", "PROMO", "STANDARD"],
              sources=[f"NATION_{i}" for i in range(10)],
              bts_lines=["Silom"], sentiments=["Positive", "Negative"], min_confidence=0.5)


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


_ASPECT_TABLE = f"SELECT aspect, \"rows\", pos, neg, neu, {NSS} AS nss, {pct('neg')} AS pct_negative FROM g"


@check("nss_by_aspect_filtered", views="reviews", ctes=f"""g AS (SELECT aspect, {COUNTS} FROM reviews
  WHERE created_at_date >= TIMESTAMP '1995-01-01' AND created_at_date <= TIMESTAMP '1998-06-30 23:59:59'
    AND sentiment_confidence >= 0.4 AND aspect IS NOT NULL GROUP BY aspect)""", sql=_ASPECT_TABLE)
def nss_by_aspect_filtered(v: Views):
    return tallies.nss_by_aspect(apply_filters(v.reviews, FLAGSHIP))


@check("nss_overall", views="reviews", ctes=f"g AS (SELECT {COUNTS} FROM reviews)",
       sql=f"SELECT \"rows\", pos, neg, neu, {NSS} AS nss, {pct('neg')} AS pct_negative FROM g")
def nss_overall(v):
    return tallies.nss_overall(v.reviews)


@check("nss_by_aspect", views="reviews", ctes=f"g AS (SELECT aspect, {COUNTS} FROM reviews GROUP BY aspect)",
       sql=_ASPECT_TABLE)
def nss_by_aspect(v):
    return tallies.nss_by_aspect(v.reviews)


@check("nss_by_aspect_pred", views="reviews", ctes="g AS (SELECT aspect_pred AS aspect, " + COUNTS.replace(
    "sentiment =", "sentiment_pred =") + " FROM reviews GROUP BY aspect_pred)", sql=_ASPECT_TABLE)
def nss_by_aspect_pred(v):
    f = Filters(label_source="predicted")
    return tallies.nss_by_aspect(apply_filters(v.reviews, f), f.aspect_col, f.sentiment_col)


@check("nss_daily", views="reviews", ctes=f"g AS (SELECT date, {COUNTS} FROM reviews GROUP BY date)",
       sql=f'SELECT date, "rows", {NSS} AS nss FROM g')
def nss_daily(v):
    return tallies.nss_table(v.reviews, "date").select("date", "rows", "nss")


@check("nss_monthly", views="reviews", ctes=f"g AS (SELECT year_month, {COUNTS} FROM reviews GROUP BY year_month)",
       sql=f'SELECT year_month, "rows", {NSS} AS nss FROM g')
def nss_monthly(v):
    return tallies.monthly(v.reviews)


@check("nss_aspect_month", views="reviews",
       ctes=f"g AS (SELECT year_month, aspect, {COUNTS} FROM reviews GROUP BY ALL HAVING count(*) >= 5)",
       sql=f'SELECT year_month, aspect, "rows", {NSS} AS nss FROM g')
def nss_aspect_month(v):
    return tallies.aspect_month(v.reviews)


@check("nss_latest_months", views="reviews", ctes=f"g AS (SELECT year_month, {COUNTS} FROM reviews GROUP BY year_month)",
       sql=f'SELECT year_month, "rows", {NSS} AS nss FROM g ORDER BY year_month DESC LIMIT 24')
def nss_latest_months(v):
    return tallies.latest_months(v.reviews, 24)


_YEARLY = f'SELECT year, "rows", pos, neg, neu, {NSS} AS nss FROM g'


@check("nss_yearly", views="reviews", ctes=f"g AS (SELECT year, {COUNTS} FROM reviews GROUP BY year)", sql=_YEARLY)
def nss_yearly(v):
    return tallies.yearly(v.reviews)


@check("nss_yearly_min20", views="scored",
       ctes=f"g AS (SELECT year, {COUNTS} FROM scored GROUP BY year HAVING count(*) >= 20)", sql=_YEARLY)
def nss_yearly_min20(v):
    return tallies.yearly(v.scored, min_rows=20)


def _cut(column, key=None):
    return (f"SELECT '{column}' AS cut, CAST({key or column} AS VARCHAR) AS key, {COUNTS} FROM reviews "
            f"WHERE {key or column} IS NOT NULL GROUP BY 2")


@check("nss_cuts_grouping_sets", views="reviews", ctes="g AS (" + " UNION ALL ".join(
    [_cut(c) for c in ("aspect", "source", "bts_line", "year", "year_month")]
    + [f"SELECT 'total' AS cut, '' AS key, {COUNTS} FROM reviews"]) + ")",
       sql=f"SELECT cut, key, \"rows\", pos, neg, neu, {NSS} AS nss, {pct('neg')} AS pct_negative FROM g")
def nss_cuts_grouping_sets(v):
    return tallies.nss_cuts(v.reviews)


@check("kpis", views="reviews", ctes=f"""g AS (SELECT {COUNTS}, count(DISTINCT aspect) AS n_aspects,
  count(DISTINCT source) AS n_sources, strftime(min(created_at_date), '%Y-%m-%d') AS date_min,
  strftime(max(created_at_date), '%Y-%m-%d') AS date_max, round(avg(sentiment_confidence), 6) AS avg_confidence FROM reviews)""",
       sql=f"SELECT \"rows\", {NSS} AS nss, {pct('pos')} AS pct_positive, {pct('neu')} AS pct_neutral, "
           f"{pct('neg')} AS pct_negative, n_aspects, n_sources, date_min, date_max, avg_confidence FROM g")
def kpis(v):
    return rounded(tallies.kpis(v.reviews), "avg_confidence")


@check("kpis_delta", views="reviews", ctes="""g AS (SELECT count(*) AS base_rows,
  count(*) FILTER (WHERE sentiment = 'Positive') AS bp, count(*) FILTER (WHERE sentiment = 'Negative') AS bn,
  count(*) FILTER (WHERE f) AS r, count(*) FILTER (WHERE f AND sentiment = 'Positive') AS p,
  count(*) FILTER (WHERE f AND sentiment = 'Negative') AS n FROM (SELECT *, created_at_date >= TIMESTAMP '1995-01-01'
    AND created_at_date <= TIMESTAMP '1998-06-30 23:59:59' AND sentiment_confidence >= 0.4 AS f FROM reviews)),
  h AS (SELECT r AS "rows", base_rows, CAST(p - n AS DOUBLE) / r * 100 AS nss, CAST(bp - bn AS DOUBLE) / base_rows * 100 AS base_nss FROM g)""",
       sql="""SELECT "rows", base_rows, nss, base_nss, CASE WHEN "rows" <> base_rows THEN "rows" - base_rows END AS rows_delta,
         CASE WHEN abs(nss - base_nss) > 0.1 THEN nss - base_nss END AS nss_delta FROM h""")
def kpis_delta(v):
    return tallies.kpi_delta(v.reviews, predicate(v.reviews, FLAGSHIP))


@check("filters_all", views="reviews", sql=f"""SELECT review_id, aspect, sentiment, sentiment_confidence FROM reviews
  WHERE created_at_date >= TIMESTAMP '1995-01-01' AND created_at_date <= TIMESTAMP '1997-12-31'
    AND aspect IN ({_in(ALL.aspects)}) AND source IN ({_in(ALL.sources)}) AND bts_line IN ('Silom')
    AND sentiment IN ('Positive', 'Negative') AND sentiment_confidence >= 0.5""")
def filters_all(v):
    return apply_filters(v.reviews, ALL).select("review_id", "aspect", "sentiment", "sentiment_confidence")


def _breakdown(key, limit=""):
    return dict(views="reviews", ctes=f"g AS (SELECT {key}, {COUNTS} FROM reviews GROUP BY {key})",
                sql=f'SELECT {key}, "rows", {NSS} AS nss, "rows" / (SELECT CAST(count(*) AS DOUBLE) FROM reviews) * 100 AS pct '
                    f'FROM g WHERE {key} IS NOT NULL ORDER BY "rows" DESC, {key} {limit}')


@check("source_breakdown", **_breakdown("source", "LIMIT 8"))
def source_breakdown(v):
    return tallies.breakdown(v.reviews, "source", top=8)


@check("line_breakdown", **_breakdown("bts_line"))
def line_breakdown(v):
    return tallies.breakdown(v.reviews, "bts_line")


@check("value_counts_sentiment", views="texts", sql="""SELECT position, label AS sentiment, (SELECT count(*) FROM texts
  WHERE sentiment = label) AS "rows" FROM (VALUES (0, 'Negative'), (1, 'Neutral'), (2, 'Positive')) AS l(position, label)""")
def value_counts_sentiment(v):
    return tallies.fixed_counts(v.texts, "sentiment", ["Negative", "Neutral", "Positive"])


@check("value_counts_rating", views="reviews", sql="""SELECT CAST(label - 1 AS INT) AS position, CAST(label AS INT) AS review_rating,
  (SELECT count(*) FROM reviews WHERE review_rating = label) AS "rows" FROM range(1, 6) AS l(label)""")
def value_counts_rating(v):
    return tallies.fixed_counts(v.reviews, "review_rating", [1, 2, 3, 4, 5])


def _values(column, view, limit=""):
    return dict(views=view, sql=f'SELECT {column}, count(*) AS "rows" FROM {view} WHERE {column} IS NOT NULL '
                                f'GROUP BY 1 ORDER BY 2 DESC, 1 {limit}')


@check("value_counts_source_top10", **_values("source", "texts", "LIMIT 10"))
def value_counts_source_top10(v):
    return tallies.value_counts(v.texts, "source", 10)


@check("value_counts_line", **_values("bts_line", "reviews"))
def value_counts_line(v):
    return tallies.value_counts(v.reviews, "bts_line")


@check("value_counts_aspect", **_values("aspect", "reviews"))
def value_counts_aspect(v):
    return cleaning.label_distribution(v.reviews)


@check("value_counts_hometown_top5", **_values("reviewer_hometown", "scored", "LIMIT 5"))
def value_counts_hometown_top5(v):
    return tallies.value_counts(v.scored, "reviewer_hometown", 5)


def _crosstab(key):
    return (f"g AS (SELECT {key}, count(*) FILTER (WHERE sentiment = 'Negative') AS \"Negative\", "
            f"count(*) FILTER (WHERE sentiment = 'Neutral') AS \"Neutral\", "
            f"count(*) FILTER (WHERE sentiment = 'Positive') AS \"Positive\", count(*) AS total FROM reviews GROUP BY 1)")


@check("crosstab_rating_sentiment", views="reviews", ctes=_crosstab("review_rating"), sql="SELECT * FROM g")
def crosstab_rating_sentiment(v):
    return tallies.crosstab(v.reviews, "review_rating")


@check("crosstab_aspect_sentiment_pct", views="reviews", ctes=_crosstab("aspect"), sql="""SELECT *,
  CAST("Negative" AS DOUBLE) / total * 100 AS pct_negative, CAST("Neutral" AS DOUBLE) / total * 100 AS pct_neutral,
  CAST("Positive" AS DOUBLE) / total * 100 AS pct_positive, CAST("Negative" AS DOUBLE) / total * 100 AS neg_pct,
  CASE WHEN CAST("Negative" AS DOUBLE) / total * 100 > 30 THEN 'critical'
       WHEN CAST("Negative" AS DOUBLE) / total * 100 > 15 THEN 'warning' ELSE 'good' END AS band FROM g""")
def crosstab_aspect_sentiment_pct(v):
    return tallies.crosstab_percent(v.reviews)


@check("mean_negative_share", views="reviews", ctes=_crosstab("aspect"),
       sql='SELECT round(avg(round_even(CAST("Negative" AS DOUBLE) / total * 100, 1)), 6) AS mean_neg_pct FROM g')
def mean_negative_share(v):
    return rounded(tallies.mean_negative_share(v.reviews), "mean_neg_pct")


@check("seasonality_long", views="reviews", sql='SELECT year, month, count(*) AS "rows" FROM reviews GROUP BY ALL')
def seasonality_long(v):
    return tallies.seasonality(v.reviews)


@check("seasonality_wide", views="reviews", sql="SELECT year, " + ", ".join(
    f'count(*) FILTER (WHERE month = {m}) AS "M{m:02d}"' for m in range(1, 13)) + " FROM reviews GROUP BY year")
def seasonality_wide(v):
    return tallies.seasonality_wide(v.reviews)


_TREND = """m AS (SELECT {g} AS g, year_month, count(*) AS r, count(*) FILTER (WHERE sentiment = 'Positive') AS p,
    count(*) FILTER (WHERE sentiment = 'Negative') AS n FROM {view} GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY year_month) AS i, count(*) OVER (PARTITION BY g) AS c FROM m),
  h AS (SELECT g, max(c) AS months,
    CAST(sum(CASE WHEN i > c // 2 THEN p - n ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN i > c // 2 THEN r ELSE 0 END), 0) * 100 AS late,
    CAST(sum(CASE WHEN i <= c // 2 THEN p - n ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN i <= c // 2 THEN r ELSE 0 END), 0) * 100 AS early
    FROM k GROUP BY g),
  t AS (SELECT g, months, late AS recent_nss, CASE WHEN months < 2 THEN late ELSE early END AS prior_nss FROM h),
  trend AS (SELECT g, months, recent_nss, prior_nss, recent_nss - prior_nss AS delta,
    CASE WHEN recent_nss - prior_nss > 5 THEN 'improving' WHEN recent_nss - prior_nss < -5 THEN 'declining' ELSE 'stable' END AS direction FROM t)"""


@check("trend_overall", views="reviews", ctes=_TREND.format(g="'all'", view="reviews"),
       sql="SELECT g AS scope, months, recent_nss, prior_nss, delta, direction FROM trend")
def trend_overall(v):
    return trends.trend(v.reviews)


@check("trend_by_aspect", views="reviews", ctes=_TREND.format(g="aspect", view="reviews"),
       sql="SELECT g AS aspect, months, recent_nss, prior_nss, delta, direction FROM trend")
def trend_by_aspect(v):
    return trends.trend(v.reviews, "aspect")


@check("trend_by_aspect_rounded", views="reviews", ctes=_TREND.format(g="aspect", view="reviews") + """,
  q AS (SELECT g, months, round_even(recent_nss, 1) AS recent_nss, round_even(coalesce(prior_nss, 0), 1) AS prior_nss FROM t)""",
       sql="""SELECT g AS aspect, months, recent_nss, prior_nss, round_even(recent_nss - prior_nss, 1) AS delta,
  CASE WHEN round_even(recent_nss - prior_nss, 1) > 5 THEN 'improving' WHEN round_even(recent_nss - prior_nss, 1) < -5
       THEN 'declining' ELSE 'stable' END AS direction FROM q""")
def trend_by_aspect_rounded(v):
    return trends.trend(v.reviews, "aspect", round_first=True)


@check("trend_by_source", views="reviews", ctes=_TREND.format(g="source", view="(SELECT * FROM reviews WHERE source IS NOT NULL)"),
       sql="SELECT g AS source, months, recent_nss, prior_nss, delta, direction FROM trend")
def trend_by_source(v):
    return trends.trend(v.reviews, "source")


def _priority(nss):
    return (f"CASE WHEN {nss} < -20 AND \"rows\" >= 500 THEN 'urgent' WHEN {nss} >= 60 AND \"rows\" >= 1000 "
            f"THEN 'leverage' ELSE 'monitor' END")


_ASPECTS = f"g AS (SELECT aspect, {COUNTS} FROM reviews GROUP BY aspect), a AS (SELECT *, {NSS} AS nss FROM g)"


@check("priority_by_aspect", views="reviews", ctes=_ASPECTS,
       sql=f'SELECT aspect, "rows", nss, {_priority("nss")} AS priority FROM a')
def priority_by_aspect(v):
    return insights.priorities(v.reviews)


@check("priority_by_aspect_rounded", views="reviews", ctes=_ASPECTS,
       sql=f'SELECT aspect, "rows", round_even(nss, 1) AS nss, {_priority("round_even(nss, 1)")} AS priority FROM a')
def priority_by_aspect_rounded(v):
    return insights.priorities(v.reviews, round_first=True)


def _summary(view):
    return _TREND.format(g="'all'", view=view) + f""", g AS (SELECT aspect, {COUNTS} FROM {view} GROUP BY aspect),
  a AS (SELECT *, {NSS} AS nss FROM g), o AS (SELECT CAST(sum(pos) - sum(neg) AS DOUBLE) / sum("rows") * 100 AS nss,
    CAST(sum("rows") AS BIGINT) AS r FROM a),
  d AS (SELECT strftime(min(created_at_date), '%Y-%m-%d') || ' → ' || strftime(max(created_at_date), '%Y-%m-%d') AS span FROM {view}),
  w AS (SELECT coalesce((SELECT aspect FROM a WHERE nss < 0 ORDER BY nss, aspect LIMIT 1), '—') AS pain,
               coalesce((SELECT aspect FROM a WHERE nss > 0 ORDER BY nss DESC, aspect LIMIT 1), '—') AS strength)"""


_SUMMARY_SQL = """SELECT o.nss AS overall_nss, o.r AS total_reviews, span AS date_range, pain AS top_pain, strength AS top_strength,
  direction AS trend_direction, 'Overall sentiment is ' || CASE direction WHEN 'improving' THEN 'improving'
    WHEN 'declining' THEN 'under pressure' ELSE 'holding steady' END || ' (NSS ' ||
    printf('%+.1f', round_even(round_even(o.nss, 2), 1)) || '%). ' || strength || ' is a standout strength; ' || pain ||
    ' demands immediate action.' AS headline FROM o, d, w, trend"""


@check("exec_summary", views="reviews", ctes=_summary("reviews"), sql=_SUMMARY_SQL)
def exec_summary(v):
    return insights.executive_summary(v.reviews)


@check("exec_summary_texts", views="scored", ctes=_summary("scored"), sql=_SUMMARY_SQL)
def exec_summary_texts(v):
    return insights.executive_summary(v.scored)


def _quote(text):
    return "'" + text.replace("'", "''") + "'"


ACTION_CASE = "CASE aspect " + " ".join(f"WHEN {_quote(a)} THEN {_quote(t)}" for a, t in tx.ACTIONS.items()) + \
    " ELSE 'Run a focused improvement sprint on ' || aspect || '.' END"


def _advice(aspect="aspect", severity="severity"):
    arms = " ".join(f"WHEN {aspect} = {_quote(a)} AND {severity} = {_quote(s)} THEN {_quote(t)}"
                    for (a, s), t in tx.CARD_ADVICE.items())
    general = " ".join(f"WHEN {severity} = {_quote(s)} THEN replace({_quote(t)}, '%s', {aspect})"
                       for s, t in tx.CARD_ADVICE_TEMPLATES.items())
    return f"CASE {arms} {general} END"


@check("action_lookup", views="scored", sql=f"SELECT review_id, aspect, {ACTION_CASE} AS action FROM scored")
def action_lookup(v):
    return v.scored.select("review_id", "aspect", insights.action(F.col("aspect")).alias("action"))


@check("card_advice_lookup", views="scored", ctes="""s AS (SELECT review_id, aspect, CASE review_rating WHEN 1 THEN 'critical'
  WHEN 2 THEN 'critical' WHEN 3 THEN 'warning' WHEN 4 THEN 'info' ELSE 'good' END AS severity FROM scored)""",
       sql=f"SELECT review_id, aspect, severity, {_advice()} AS recommendation FROM s")
def card_advice_lookup(v):
    r = F.col("review_rating")
    severity = F.when(r <= 2, "critical").when(r == 3, "warning").when(r == 4, "info").otherwise("good")
    return v.scored.select("review_id", "aspect", severity.alias("severity"),
                           insights.card_advice(F.col("aspect"), severity).alias("recommendation"))


def _cards(view):
    return dict(views=view, ctes=f"""g AS (SELECT aspect, {COUNTS} FROM {view} GROUP BY aspect),
  a AS (SELECT *, {NSS} AS nss, CAST(neg AS DOUBLE) / "rows" * 100 AS np FROM g),
  c AS (SELECT *, CASE WHEN nss < -20 AND "rows" >= 500 THEN 'critical' WHEN nss >= 60 AND "rows" >= 1000 THEN 'good' END AS severity,
     printf('%+.1f', round_even(nss, 1)) AS signed FROM a),
  q AS (SELECT avg(CASE WHEN aspect = aspect_pred THEN 1 ELSE 0 END) * 100 AS agree,
               avg(CASE WHEN sentiment_confidence < 0.5 THEN 1 ELSE 0 END) * 100 AS low FROM {view})""",
                sql=f"""SELECT CASE severity WHEN 'critical' THEN 1 ELSE 2 END AS section,
  CASE severity WHEN 'critical' THEN nss ELSE -nss END AS position,
  CASE severity WHEN 'critical' THEN 'Critical pain: ' ELSE 'Strength to amplify: ' END || aspect AS title,
  'NSS = ' || signed || '% across ' || "rows" || ' reviews — ' || CASE severity WHEN 'critical'
     THEN printf('%.0f', round_even(np, 0)) || '% are negative.' ELSE 'riders consistently praise this.' END AS finding,
  {_advice()} AS recommendation, severity, 'NSS ' || signed || '%' AS metric FROM c WHERE severity IS NOT NULL
UNION ALL SELECT 3, 0.0, {_quote(tx.AGREEMENT_CARD['title'])}, printf({_quote(tx.AGREEMENT_CARD['finding'])}, round_even(agree, 1)),
  {_quote(tx.AGREEMENT_CARD['recommendation'])}, 'warning', printf('Agreement %.1f%%', round_even(agree, 1)) FROM q WHERE agree < 50
UNION ALL SELECT 4, 0.0, {_quote(tx.CONFIDENCE_CARD['title'])}, printf({_quote(tx.CONFIDENCE_CARD['finding'])}, round_even(low, 1), 0.5::DOUBLE),
  {_quote(tx.CONFIDENCE_CARD['recommendation'])}, 'info', printf('Low-conf %.1f%%', round_even(low, 1)) FROM q WHERE low > 10""")


@check("insight_cards", **_cards("reviews"))
def insight_cards(v):
    return insights.insight_cards(v.reviews)


@check("insight_cards_texts", **_cards("scored"))
def insight_cards_texts(v):
    return insights.insight_cards(v.scored)


@check("meta_values", views="reviews", sql="""SELECT DISTINCT kind, value FROM (SELECT 'source' AS kind, source AS value FROM reviews
  UNION ALL SELECT 'bts_line', bts_line FROM reviews UNION ALL SELECT 'aspect', aspect FROM reviews) WHERE value IS NOT NULL""")
def meta_values(v):
    return tallies.meta_values(v.reviews)


@check("date_bounds", views="reviews", sql="SELECT strftime(min(created_at_date), '%Y-%m-%d') AS date_min, "
                                           "strftime(max(created_at_date), '%Y-%m-%d') AS date_max FROM reviews")
def date_bounds(v):
    return tallies.date_bounds(v.reviews)


_PROFILED = ["review_id", "review_rating", "source", "created_at_date", "bts_line", "aspect", "sentiment", "aspect_pred",
             "sentiment_pred", "sentiment_confidence"]


@check("missing_profile", views="reviews", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 AS pct "
    f"FROM reviews" for c in _PROFILED))
def missing_profile(v):
    return profile.missing_profile(v.labelled_rows)


def _describe(c, numeric):
    n = f"CAST({c} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM reviews) AS n, (SELECT count(DISTINCT {c}) FROM reviews) AS n_distinct,
  (SELECT CAST({c} AS VARCHAR) FROM reviews WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS top,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM reviews WHERE {c} IS NOT NULL GROUP BY {c})) AS freq,
  (SELECT round(avg({n}), 6) FROM reviews) AS mean, (SELECT round(stddev_samp({n}), 6) FROM reviews) AS std, (SELECT min({n}) FROM reviews) AS min,
  (SELECT round(quantile_cont({n}, 0.25), 6) FROM reviews) AS q1, (SELECT round(quantile_cont({n}, 0.5), 6) FROM reviews) AS median,
  (SELECT round(quantile_cont({n}, 0.75), 6) FROM reviews) AS q3, (SELECT max({n}) FROM reviews) AS max"""


@check("describe_columns", views="reviews", sql=" UNION ALL ".join(
    _describe(c, c in ("review_rating", "sentiment_confidence")) for c in
    _PROFILED))
def describe_columns(v):
    return rounded(profile.describe_all(v.labelled_rows), "mean", "std", "q1", "median", "q3")


@check("quadrant", views="reviews", ctes=f"g AS (SELECT aspect, {COUNTS} FROM reviews GROUP BY aspect)",
       sql=f"""SELECT aspect, "rows", {NSS} AS nss, (SELECT quantile_cont("rows", 0.5) FROM g) AS median_rows,
  (SELECT list_sort(list("rows"))[count(*) // 2 + 1] FROM g) AS upper_median_rows,
  CASE WHEN {NSS} < 0 THEN 'critical' WHEN {NSS} < 30 THEN 'warning' ELSE 'good' END AS band FROM g""")
def quadrant(v):
    return tallies.quadrant(v.reviews)


@check("gauges", views="reviews", ctes=_ASPECTS, sql="""SELECT aspect, nss, least(greatest((nss + 100) / 200, 0), 1) AS gauge,
  abs(nss) / greatest((SELECT max(abs(nss)) FROM a), 1) AS bar FROM a""")
def gauges(v):
    return tallies.gauges(v.reviews)


@check("nss_bands", views="reviews", ctes=f"g AS (SELECT source, {COUNTS} FROM reviews WHERE source IS NOT NULL GROUP BY source)",
       sql=f"SELECT source, {NSS} AS nss, CASE WHEN {NSS} < 0 THEN 'critical' WHEN {NSS} < 30 THEN 'warning' ELSE 'good' END AS band FROM g")
def nss_bands(v):
    return tallies.nss_table(v.reviews, "source").select("source", "nss", ex.nss_band(F.col("nss")).alias("band"))

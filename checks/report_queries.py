"""Composed reports: every table of a report in one result."""

from checks import tally_queries, text_queries  # noqa: F401  (their statements are parts of the reports)
from checks.model_queries import _AVERAGES, _COUNTED, _GRID, _TYPES, _report
from checks.registry import CHECKS, COUNTS, NSS, check
from tonecast.plans import reports


def _section(name, sql, numbers=(), texts=(), digits=None):
    """Rows (section, key, item, value, text) of a statement; numbers are rounded half to even as ``digits`` says."""
    keys = reports.TABLE_KEYS.get(name, [])
    key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) or "''"
    shown = {c: f"round_even({c}, {d})" for d, columns in (digits or {}).items() for c in columns}
    rows = [f"SELECT '{name}' AS section, {key} AS key, '{c.strip(chr(34))}' AS item, CAST({shown.get(c, c)} AS DOUBLE) AS value, "
            f"CAST(NULL AS VARCHAR) AS text FROM ({sql})" for c in numbers]
    rows += [f"SELECT '{name}', {key}, '{c}', CAST(NULL AS DOUBLE), {c} FROM ({sql})" for c in texts]
    return " UNION ALL ".join(rows)


def _union(*sections):
    return " UNION ALL ".join(sections)


_ROWS = '"rows"'
_QUALITY = ("accuracy", "macro_f1", "weighted_f1")
_PER_ASPECT = f"WITH {_report(key='aspect', explicit=False)} SELECT aspect, {_AVERAGES} FROM report WHERE aspect IS NOT NULL GROUP BY aspect HAVING sum(support) >= 30"


@check("report_performance", views="reviews", sql=_union(
    _section("overall", CHECKS["accuracy_f1_all_labels"].sql, _QUALITY, digits={4: _QUALITY}),
    _section("confusion", CHECKS["confusion"].sql, (_ROWS, "share"), digits={4: ("share",)}),
    _section("per_class", CHECKS["class_report"].sql, ("precision", "recall", "f1", "support"), digits={4: ("precision", "recall", "f1")}),
    _section("calibration", CHECKS["calibration"].sql, ("accuracy", "avg_conf", _ROWS), digits={4: ("accuracy", "avg_conf")}),
    _section("agreement", CHECKS["aspect_agreement"].sql, (_ROWS, "agreement"), digits={4: ("agreement",)}),
    _section("aspect_confusion", CHECKS["aspect_confusion"].sql, (_ROWS, "share"), digits={4: ("share",)}),
    _section("per_aspect", _PER_ASPECT, (_ROWS, *_QUALITY), digits={4: _QUALITY})))
def report_performance(v):
    return reports.flat(reports.composed(reports.performance, v.reviews))


_SCORES = ("nss", "pct_negative", "pct_positive", "recent_nss", "prior_nss", "delta")
_SOURCES = f"""SELECT source, "rows", {NSS} AS nss, "rows" / (SELECT CAST(count(*) AS DOUBLE) FROM scored) * 100 AS pct
  FROM (SELECT source, {COUNTS} FROM scored GROUP BY source) WHERE source IS NOT NULL ORDER BY "rows" DESC, source LIMIT 8"""
_YEARS = f'SELECT year, "rows", {NSS} AS nss FROM (SELECT year, {COUNTS} FROM scored WHERE year IS NOT NULL GROUP BY year)'


@check("report_business", views="scored", sql=_union(
    _section("summary", CHECKS["exec_summary_texts"].sql, ("overall_nss", "total_reviews"),
             ("date_range", "top_pain", "top_strength", "trend_direction", "headline"), {2: ("overall_nss",)}),
    _section("deep_dives", CHECKS["aspect_deep_dive"].sql, (_ROWS, *_SCORES),
             ("top_complaints", "top_praises", "direction", "priority", "action"), {1: _SCORES}),
    _section("sources", _SOURCES, (_ROWS, "nss", "pct"), digits={1: ("nss", "pct")}),
    _section("yearly", _YEARS, ("nss", _ROWS), digits={1: ("nss",)})))
def report_business(v):
    return reports.flat(reports.composed(reports.business, v.scored))


_WRONG = "count(*) FILTER (WHERE sentiment <> sentiment_pred)"
_ERRORS = f"SELECT count(*) AS total, {_WRONG} AS total_errors, {_COUNTED}, CAST({_WRONG} AS DOUBLE) / greatest(count(*), 1) * 100 AS error_rate FROM scored"
_BY_ASPECT = f"""SELECT aspect, count(*) AS "rows", {_WRONG} AS errors, count(*) FILTER (WHERE {_TYPES['false_positive']}) AS fp,
  count(*) FILTER (WHERE {_TYPES['false_negative']}) AS fn, count(*) FILTER (WHERE {_TYPES['false_neutral']}) AS false_neutral,
  CAST({_WRONG} AS DOUBLE) / count(*) * 100 AS error_rate FROM scored GROUP BY aspect HAVING count(*) >= 20"""
_PAIRS = f"""SELECT t.label AS true_label, p.label AS pred_label,
  (SELECT count(*) FROM scored WHERE sentiment = t.label AND sentiment_pred = p.label) AS "rows" FROM {_GRID} AS t(label), {_GRID} AS p(label)"""


@check("report_error_analysis", views="scored", sql=_union(
    _section("summary", _ERRORS, ("total", "total_errors", *_TYPES, "error_rate"), digits={1: ("error_rate",)}),
    _section("types", CHECKS["error_types"].sql.replace("FROM reviews WHERE", "FROM scored WHERE"), (_ROWS,)),
    _section("confusion", _PAIRS, (_ROWS,)),
    _section("samples", CHECKS["error_samples_view"].sql, ("rating", "confidence"), ("text", "source", "sentiment", "date", "aspect", "predicted")),
    _section("by_aspect", _BY_ASPECT, (_ROWS, "errors", "fp", "fn", "false_neutral", "error_rate"), digits={1: ("error_rate",)})))
def report_error_analysis(v):
    return reports.flat(reports.composed(reports.error_analysis, v.scored))

"""Queries on label cleaning, text ids, caches, splits, row selection."""

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import DUCK_TEST, rule_case
from tonecast import taxonomy as tx
from tonecast.functions import expressions as ex
from tonecast.operators import cleaning, evaluation, splits
from tonecast.operators.filters import Filters
from tonecast.sources import caches, readers

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
TEXT_ID = "substring(sha256(lower(trim(regexp_replace(review_text, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+', ' ', 'g')))), 1, 16)"


def _map_sql(column, mapping):
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items()) + " END"


def _in(names):
    return ", ".join(f"'{n}'" for n in names)


_CLEAN = f"""c AS (SELECT *, {_STRIP.format('sentiment')} AS s, {_STRIP.format('aspect')} AS raw_aspect FROM raw),
  m AS (SELECT *, {_map_sql('raw_aspect', {**{a: a for a in tx.CANONICAL_ASPECTS}, **tx.CANONICAL_ALIASES})} AS mapped FROM c
        WHERE s IN ('Negative', 'Neutral', 'Positive') AND raw_aspect NOT IN ({_in(tx.PSEUDO_ASPECTS)})),
  clean AS (SELECT review_id, review_text, created_at_date, s AS sentiment, raw_aspect AS aspect_raw, mapped AS aspect, {TEXT_ID} AS text_id FROM m WHERE mapped IS NOT NULL)"""


@check("clean_labels_map", views="raw", ctes=_CLEAN, sql="SELECT review_id, sentiment, aspect_raw, aspect, text_id FROM clean")
def clean_labels_map(v):
    return cleaning.clean_labels(v.raw).select("review_id", "sentiment", "aspect_raw", "aspect", "text_id")


@check("prepare_cleaned", views="raw", ctes=f"c AS (SELECT *, {_STRIP.format('sentiment')} AS s, {_STRIP.format('aspect')} AS a FROM raw)",
       sql=f"""SELECT review_id, a AS aspect, s AS sentiment, {TEXT_ID} AS text_id FROM c
  WHERE s IN ('Negative', 'Neutral', 'Positive') AND a IN ({_in(tx.MERGED_ASPECTS)})""")
def prepare_cleaned(v):
    return cleaning.prepare_cleaned(v.raw).select("review_id", "aspect", "sentiment", "text_id")


_MERGED = f"coalesce({_map_sql('aspect', tx.MERGED_ALIASES)}, aspect)"


@check("merge_labels_replace", views="raw", sql=f"SELECT review_id, {_MERGED} AS aspect FROM raw")
def merge_labels_replace(v):
    return cleaning.merge_labels(v.raw).select("review_id", "aspect")


@check("rule_aspect", views="texts", sql=f"SELECT review_id, {rule_case(DUCK_TEST)} AS aspect_pred FROM texts")
def rule_aspect(v):
    return cleaning.with_rule_aspect(v.texts).select("review_id", "aspect_pred")


_REASSIGN = (f"r AS (SELECT review_id, CASE WHEN aspect IN ({_in(tx.PSEUDO_ASPECTS)}) THEN "
             f"{rule_case(DUCK_TEST, fallback=tx.OFF_TOPIC)} ELSE aspect END AS aspect FROM (SELECT review_id, review_text, {_MERGED} AS aspect FROM raw))")


@check("reassign_aspect", views="raw", ctes=_REASSIGN, sql="SELECT review_id, aspect FROM r WHERE aspect <> 'Irrelevant' OR aspect IS NULL")
def reassign_aspect(v):
    return cleaning.clean_reviews(v.raw).select("review_id", "aspect")


@check("label_distribution_reassigned", views="raw", ctes=_REASSIGN,
       sql='SELECT aspect, count(*) AS "rows" FROM r WHERE aspect IS NOT NULL GROUP BY aspect')
def label_distribution_reassigned(v):
    return cleaning.label_distribution(cleaning.reassign_pseudo(cleaning.merge_labels(v.raw), keep_off_topic=True))


@check("text_id", views="texts", sql=f"SELECT review_id, {TEXT_ID} AS text_id FROM texts")
def text_id(v):
    return v.texts.select("review_id", ex.text_id(F.col("review_text")).alias("text_id"))


_PARSED = """p AS (SELECT review_id, coalesce(try_strptime(created_at_date, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S']),
  try_strptime(created_at_date, '%m/%d/%Y'), try_strptime(created_at_date, '%d/%m/%Y'), try_strptime(created_at_date, '%Y/%m/%d')) AS ts FROM raw)"""
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at"


@check("lenient_dates", views="raw", ctes=_PARSED, sql=f"SELECT review_id, {_STAMP} FROM p WHERE ts IS NOT NULL")
def lenient_dates(v):
    return cleaning.with_dates(v.raw).select("review_id", F.date_format("created_at_date", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@check("dashboard_table", views="raw", ctes=_PARSED, sql=f"""SELECT review_id, {_STAMP}, strftime(ts, '%Y-%m') AS year_month,
  CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, strftime(ts, '%Y-%m-%d') AS date FROM p
  WHERE ts IS NOT NULL AND NOT (year(ts) = 2020 AND month(ts) = 4) AND NOT (year(ts) = 2015 AND month(ts) = 12)""")
def dashboard_table(v):
    table = cleaning.dashboard_table(v.raw, ((2020, 4), (2015, 12)))
    return table.select("review_id", F.date_format("created_at_date", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                        "year_month", "year", "month", "date")


@check("text_previews", views="texts", sql="SELECT review_id, substring(review_text, 1, 180) AS p180, substring(review_text, 1, 200) AS p200, "
                                           "substring(review_text, 1, 350) AS p350, coalesce(review_rating, 0) AS rating FROM texts")
def text_previews(v):
    text = F.col("review_text")
    return v.texts.select("review_id", ex.preview(text, 180).alias("p180"), ex.preview(text, 200).alias("p200"),
                          ex.preview(text, 350).alias("p350"), F.coalesce("review_rating", F.lit(0)).alias("rating"))


@check("model_input_pairs", views="scored", sql="SELECT review_id, md5('Aspect: ' || aspect || chr(10) || 'Review: ' || review_text) AS pair_md5 FROM scored")
def model_input_pairs(v):
    return v.scored.select("review_id", F.md5(ex.model_input(F.col("aspect"), F.col("review_text"))).alias("pair_md5"))


@check("complete_pairs", views="raw", sql="SELECT review_text, aspect FROM raw WHERE review_text IS NOT NULL AND aspect IS NOT NULL")
def complete_pairs(v):
    return readers.read_pairs(v.raw)


@check("known_columns", views="raw", sql="SELECT review_text, review_rating, source, aspect, sentiment FROM raw")
def known_columns(v):
    return cleaning.project_known(v.raw, ["review_text", "review_rating", "source", "aspect", "sentiment", "sentiment_pred"])


@check("label_source_switch", views="reviews", sql="SELECT review_id, aspect_pred AS a, sentiment_pred AS s FROM reviews WHERE sentiment_pred IN ('Neutral')")
def label_source_switch(v):
    from tonecast.operators.filters import with_labels
    return with_labels(v.reviews, Filters(sentiments=["Neutral"], label_source="predicted")).select("review_id", "a", "s")


@check("row_cap", views="reviews", sql="SELECT review_id, aspect FROM reviews ORDER BY review_id LIMIT 5000")
def row_cap(v):
    return cleaning.first_rows(v.reviews, 5000, "review_id").select("review_id", "aspect")


_SAMPLE = "SELECT review_id, aspect FROM reviews ORDER BY md5('42:' || review_id), review_id LIMIT 5000"


@check("seeded_sample", views="reviews", sql=_SAMPLE)
def seeded_sample(v):
    return cleaning.sample_rows(v.reviews, 5000).select("review_id", "aspect")


# ---- caches: labelled texts are already cached ------------------------------------------

_CACHE = f"""ids AS (SELECT *, {TEXT_ID} AS text_id, {rule_case(DUCK_TEST)} AS ruled FROM texts),
  cache AS (SELECT text_id, min('cached ' || ruled) AS aspect_pred FROM ids WHERE sentiment IS NOT NULL GROUP BY text_id)"""


def _ids(v):
    return v.texts.withColumn("text_id", ex.text_id(F.col("review_text")))


def _cache(v):
    labelled = cleaning.with_rule_aspect(_ids(v).filter("sentiment IS NOT NULL"))
    return labelled.select("text_id", F.concat(F.lit("cached "), "aspect_pred").alias("aspect_pred"))


@check("cache_left_join", views="texts", ctes=_CACHE, sql="SELECT review_id, text_id, aspect_pred FROM ids LEFT JOIN cache USING (text_id)")
def cache_left_join(v):
    return caches.attach_cached(_ids(v), _cache(v)).select("review_id", "text_id", "aspect_pred")


@check("cache_missing", views="texts", ctes=_CACHE, sql="SELECT review_id, text_id FROM ids WHERE text_id NOT IN (SELECT text_id FROM cache)")
def cache_missing(v):
    return caches.missing_from(_ids(v), _cache(v)).select("review_id", "text_id")


_GROWN = _CACHE + """, fresh AS (SELECT text_id, min(ruled) AS aspect_pred FROM ids WHERE text_id NOT IN (SELECT text_id FROM cache) GROUP BY text_id),
  grown AS (SELECT * FROM cache UNION ALL SELECT * FROM fresh)"""


@check("cache_upsert", views="texts", ctes=_GROWN, sql="SELECT text_id, aspect_pred FROM grown")
def cache_upsert(v):
    return caches.complete_cache(_ids(v), _cache(v), cleaning.with_rule_aspect)[1]


@check("cache_completed_rows", views="texts", ctes=_GROWN, sql="SELECT review_id, text_id, aspect_pred FROM ids LEFT JOIN grown USING (text_id)")
def cache_completed_rows(v):
    return caches.complete_cache(_ids(v), _cache(v), cleaning.with_rule_aspect)[0].select("review_id", "text_id", "aspect_pred")


# ---- splits ----------------------------------------------------------------------------

def fold_sql(key, folds=5):
    return f"CAST(CAST('0x' || substring(md5('42:' || {key}), 1, 8) AS BIGINT) % {folds} AS INT)"


def split_sql(fold):
    return f"CASE {fold} WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


_SPLIT = f"ids AS (SELECT *, {TEXT_ID} AS text_id FROM texts), sp AS (SELECT *, {split_sql(fold_sql('text_id'))} AS split FROM ids)"


@check("group_split", views="texts", ctes=_SPLIT, sql="SELECT review_id, text_id, split FROM sp")
def group_split(v):
    return splits.with_split(_ids(v)).select("review_id", "text_id", "split")


_STRATIFIED = f"""ids AS (SELECT *, {TEXT_ID} AS text_id FROM scored), n AS (SELECT text_id, sentiment, count(*) AS n FROM ids GROUP BY ALL),
  g AS (SELECT text_id, first(sentiment ORDER BY n DESC, sentiment) AS label, CAST(sum(n) AS BIGINT) AS "rows" FROM n GROUP BY text_id),
  f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || text_id), text_id) - 1) % 5 AS INT) AS fold FROM g)"""


def _scored_ids(v):
    return v.scored.withColumn("text_id", ex.text_id(F.col("review_text")))


@check("stratified_folds", views="scored", ctes=_STRATIFIED, sql=f"SELECT text_id, label, \"rows\", fold, {split_sql('fold')} AS split FROM f")
def stratified_folds(v):
    return splits.stratified_folds(_scored_ids(v))


# most texts have no label here
_SPARSE = _STRATIFIED.replace("FROM scored)", "FROM texts)").replace(
    "first(sentiment ORDER BY n DESC, sentiment)", "first(sentiment ORDER BY n DESC, sentiment) FILTER (WHERE sentiment IS NOT NULL)")


@check("stratified_folds_missing_labels", views="texts", ctes=_SPARSE,
       sql=f"SELECT text_id, label, \"rows\", fold, {split_sql('fold')} AS split FROM f")
def stratified_folds_missing_labels(v):
    return splits.stratified_folds(_ids(v))


@check("stratified_split_rows", views="scored", ctes=_STRATIFIED,
       sql=f"SELECT review_id, ids.text_id, {split_sql('fold')} AS split FROM ids JOIN f USING (text_id)")
def stratified_split_rows(v):
    rows = _scored_ids(v)
    return splits.attach_split(rows, splits.stratified_folds(rows)).select("review_id", "text_id", "split")


# a split by review instead of by text leaks copies
_LEAKY = f"ids AS (SELECT *, {TEXT_ID} AS text_id FROM texts), sp AS (SELECT *, {split_sql(fold_sql('review_id'))} AS split FROM ids)"


def _leaky(v):
    return _ids(v).withColumn("split", splits.split_name(splits.hash_fold(F.col("review_id"))))


@check("split_leakage", views="texts", ctes=_LEAKY, sql="SELECT text_id, count(DISTINCT split) AS n_splits FROM sp GROUP BY text_id HAVING count(DISTINCT split) > 1")
def split_leakage(v):
    return splits.leaking_groups(_leaky(v))


def _pair_count(a, b):
    return (f"(SELECT count(*) FROM (SELECT text_id FROM sp WHERE split = '{a}' INTERSECT SELECT text_id FROM sp WHERE split = '{b}')) "
            f"AS {a}_{b}")


@check("split_leakage_counts", views="texts", ctes=_LEAKY,
       sql=f"SELECT {_pair_count('train', 'val')}, {_pair_count('train', 'test')}, {_pair_count('val', 'test')}")
def split_leakage_counts(v):
    return splits.leakage_counts(_leaky(v))


@check("split_no_leakage", views="texts", ctes=_SPLIT,
       sql=f"SELECT {_pair_count('train', 'val')}, {_pair_count('train', 'test')}, {_pair_count('val', 'test')}")
def split_no_leakage(v):
    return splits.leakage_counts(splits.with_split(_ids(v)))


@check("shared_groups", views="texts", ctes=_LEAKY,
       sql="SELECT text_id FROM sp WHERE split = 'train' INTERSECT SELECT text_id FROM sp WHERE split = 'test'")
def shared_groups(v):
    rows = _leaky(v)
    return splits.shared_groups(rows.filter("split = 'train'"), rows.filter("split = 'test'"))


@check("remaining_groups", views="texts", ctes=_SPLIT, sql="SELECT DISTINCT text_id FROM sp WHERE split = 'train'")
def remaining_groups(v):
    rows = splits.with_split(_ids(v))
    return splits.remaining_groups(rows, rows.filter("split = 'test'"), rows.filter("split = 'val'"))


@check("label_union", views="reviews", sql="SELECT aspect AS label FROM reviews UNION SELECT aspect_pred FROM reviews")
def label_union(v):
    return evaluation.label_union(v.reviews, "aspect", "aspect_pred")

"""Queries on texts: profile, tokens, phrases, deep dives, retrieval, contexts."""

from pyspark.sql import functions as F

from checks.registry import COUNTS, NSS, check, pct, rounded
from checks.tally_queries import ACTION_CASE, _TREND, _priority
from tonecast import taxonomy as tx
from tonecast.functions import expressions as ex
from tonecast.functions import tokens as tk
from tonecast.operators import cleaning, insights, phrases, profile, retrieval, scaling, vector_index
from tonecast.plans import reports
from tonecast.sources import caches

_WORD = r"[\p{L}\p{N}_]+"


def words_sql(variant: str, text: str = "review_text") -> str:
    stop, urls = tk.VARIANTS[variant]
    source = f"regexp_replace({text}, 'https?://\\S+|www\\.\\S+', ' ', 'g')" if urls else text
    listed = ", ".join(f"'{w}'" for w in stop)
    return (f"list_filter(regexp_extract_all(lower({source}), '{_WORD}'), "
            f"lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains([{listed}], w))")


def grams_sql(n: int, words: str = "w") -> str:
    joined = " || ' ' || ".join(f"{words}[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len({words}) - {n} + 2), lambda i: {joined})"


# ---- profile ---------------------------------------------------------------------------

_LENGTHS = """l AS (SELECT *, CAST(length(review_text) AS BIGINT) AS text_length,
  CAST(len(list_filter(regexp_split_to_array(review_text, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+'), lambda w: w <> '')) AS BIGINT) AS word_count FROM scored)"""


def _length_stats(group=None):
    keys = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return " UNION ALL ".join(f"""SELECT {keys}'{m}' AS measure, count(*) AS n, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std,
  min({m}) AS min, quantile_cont({m}, 0.25) AS q1, quantile_cont({m}, 0.5) AS median, quantile_cont({m}, 0.75) AS q3,
  max({m}) AS max FROM l {by}""" for m in ("text_length", "word_count"))


@check("text_lengths", views="scored", ctes=_LENGTHS,
       sql="SELECT review_id, CAST(text_length AS INT) AS text_length, CAST(word_count AS INT) AS word_count FROM l")
def text_lengths(v):
    return cleaning.with_lengths(v.scored).select("review_id", "text_length", "word_count")


@check("length_stats", views="scored", ctes=_LENGTHS, sql=_length_stats())
def length_stats(v):
    return rounded(profile.length_stats(cleaning.with_lengths(v.scored)), "mean", "std")


@check("length_stats_by_sentiment", views="scored", ctes=_LENGTHS, sql=_length_stats("sentiment"))
def length_stats_by_sentiment(v):
    return rounded(profile.length_stats(cleaning.with_lengths(v.scored), "sentiment"), "mean", "std")


def _histogram(column, clip):
    return dict(views="scored", ctes=_LENGTHS + f""", c AS (SELECT least({column}, {clip}) AS v FROM l),
  b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM c),
  h AS (SELECT CAST(least(floor((v - lo) / w), 49) AS INT) AS bin, count(*) AS "rows", min(lo) AS lo, min(w) AS w FROM c, b GROUP BY 1)""",
                sql='SELECT bin, "rows", lo + bin * w AS lower, lo + (bin + 1) * w AS upper FROM h')


@check("length_histogram", **_histogram("text_length", 2000))
def length_histogram(v):
    return profile.histogram(cleaning.with_lengths(v.scored), "text_length", 2000)


@check("word_count_histogram", **_histogram("word_count", 300))
def word_count_histogram(v):
    return profile.histogram(cleaning.with_lengths(v.scored), "word_count", 300)


@check("eda_summary", views="scored", ctes=_LENGTHS + f""",
  t AS (SELECT unnest({words_sql('plain')}) AS term FROM l), g AS (SELECT {COUNTS} FROM l)""",
       sql=f"""SELECT "rows", pos, neg, {pct('pos')} AS pct_positive, {pct('neg')} AS pct_negative, {NSS} AS nss,
  (SELECT round(avg(text_length), 6) FROM l) AS avg_length, (SELECT quantile_cont(text_length, 0.5) FROM l) AS median_length,
  (SELECT round(avg(word_count), 6) FROM l) AS avg_words, (SELECT quantile_cont(word_count, 0.5) FROM l) AS median_words,
  (SELECT count(DISTINCT term) FROM t) AS vocabulary, (SELECT count(*) FROM t) AS tokens,
  (SELECT strftime(min(created_at_date), '%Y-%m-%d') FROM l) AS date_min, (SELECT strftime(max(created_at_date), '%Y-%m-%d') FROM l) AS date_max,
  (SELECT string_agg(source, ', ' ORDER BY source) FROM (SELECT DISTINCT source FROM l WHERE source IS NOT NULL)) AS sources,
  (SELECT string_agg(bts_line, ', ' ORDER BY bts_line) FROM (SELECT DISTINCT bts_line FROM l WHERE bts_line IS NOT NULL)) AS bts_lines,
  (SELECT count(DISTINCT aspect) FROM l) AS n_aspects FROM g""")
def eda_summary(v):
    return rounded(profile.summary_record(cleaning.with_lengths(v.scored)), "avg_length", "avg_words")


# ---- tokens and phrases ----------------------------------------------------------------

def _terms(variant, view="texts", where=""):
    return f"t AS (SELECT *, unnest({words_sql(variant)}) AS term FROM {view} {where})"


@check("tokens_vocab", views="texts", ctes=_terms("plain"),
       sql="SELECT count(*) AS tokens, count(DISTINCT term) AS vocabulary FROM t")
def tokens_vocab(v):
    return phrases.vocabulary_size(v.texts)


_TOP = """SELECT term, count(*) AS "count", CAST(count(*) AS DOUBLE) / (SELECT max(n) FROM (SELECT count(*) AS n FROM t GROUP BY term)) AS weight
  FROM t GROUP BY term ORDER BY 2 DESC, 1 LIMIT {n}"""


@check("top_terms", views="texts", ctes=_terms("plain"), sql=_TOP.format(n=30))
def top_terms(v):
    return phrases.top_terms(v.texts)


@check("cloud_positive", views="scored", ctes=_terms("voice", "scored", "WHERE sentiment = 'Positive'"), sql=_TOP.format(n=150))
def cloud_positive(v):
    return phrases.cloud(v.scored, "positive")


@check("cloud_negative", views="scored", ctes=_terms("voice", "scored", "WHERE sentiment = 'Negative'"), sql=_TOP.format(n=150))
def cloud_negative(v):
    return phrases.cloud(v.scored, "any other value")


@check("top_terms_by_sentiment", views="texts", ctes=_terms("plain") + """,
  c AS (SELECT CASE WHEN sentiment = 'Positive' THEN 'Positive' ELSE 'Negative' END AS polarity, term, count(*) AS "count" FROM t GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY polarity ORDER BY "count" DESC, term) AS INT) AS rank FROM c)""",
       sql="SELECT * FROM r WHERE rank <= 20")
def top_terms_by_sentiment(v):
    return phrases.top_terms_by_polarity(v.texts)


def _grams(variant, view, lo=2, hi=2, where="", rank_keys="", n=20):
    lists = " || ".join(grams_sql(k) for k in range(lo, hi + 1))
    keys = f"{rank_keys}, " if rank_keys else ""
    part = f"PARTITION BY {rank_keys}" if rank_keys else ""
    return f"""w AS (SELECT *, {words_sql(variant)} AS w FROM {view} {where}),
  n AS (SELECT {keys}unnest({lists}) AS ngram FROM w), c AS (SELECT {keys}ngram, count(*) AS "count" FROM n GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER ({part} ORDER BY "count" DESC, ngram) AS INT) AS rank FROM c),
  top AS (SELECT * FROM r WHERE rank <= {n})"""


_BOTH = "WHERE sentiment IN ('Positive', 'Negative')"


@check("bigrams_by_sentiment", views="scored",
       ctes="p AS (SELECT *, sentiment AS polarity FROM scored " + _BOTH + "), " + _grams("voice", "p", rank_keys="polarity"),
       sql="SELECT * FROM top")
def bigrams_by_sentiment(v):
    return phrases.voice(v.scored)


@check("voice_one_aspect", views="scored",
       ctes="p AS (SELECT *, sentiment AS polarity FROM scored " + _BOTH + " AND aspect = 'Cleanliness & Hygiene'), "
            + _grams("voice", "p", rank_keys="polarity"), sql="SELECT * FROM top")
def voice_one_aspect(v):
    return phrases.voice(v.scored, aspect="Cleanliness & Hygiene")


@check("ngrams_1_3", views="texts", ctes=_grams("voice", "texts", 1, 3, n=50), sql='SELECT ngram, "count" FROM top')
def ngrams_1_3(v):
    return phrases.top_phrases(v.texts, 50, 1, 3)


@check("ngrams_summarised", views="texts", ctes=_grams("voice", "texts", 1, 3, n=50), sql='SELECT ngram, "count" FROM top')
def ngrams_summarised(v):
    """The same through bounded summaries and a recount of the candidates."""
    return phrases.top_phrases(v.texts, 50, 1, 3, capacity=2_000)


@check("bigrams_context_variant", views="texts", ctes=_grams("context", "texts", n=30), sql='SELECT ngram, "count" FROM top')
def bigrams_context_variant(v):
    return phrases.top_phrases(v.texts, 30, variant="context")


# ---- aspects and phrases together ------------------------------------------------------

def _dive(n, variant="business"):
    return (_grams(variant, "scored", where=_BOTH, rank_keys="aspect, sentiment", n=n) + """,
  lists AS (SELECT aspect, coalesce(string_agg(ngram, ', ' ORDER BY rank) FILTER (WHERE sentiment = 'Negative'), '') AS top_complaints,
    coalesce(string_agg(ngram, ', ' ORDER BY rank) FILTER (WHERE sentiment = 'Positive'), '') AS top_praises FROM top GROUP BY aspect), """
            + _TREND.format(g="aspect", view="scored") + f""", b AS (SELECT aspect, {COUNTS} FROM scored GROUP BY aspect),
  a AS (SELECT *, {NSS} AS nss FROM b)""")


@check("aspect_deep_dive", views="scored", ctes=_dive(5), sql=f"""SELECT a.aspect, nss, "rows", {pct('neg')} AS pct_negative,
  {pct('pos')} AS pct_positive, coalesce(top_complaints, '') AS top_complaints, coalesce(top_praises, '') AS top_praises, direction,
  recent_nss, prior_nss, delta, {_priority('nss')} AS priority, {ACTION_CASE.replace('aspect', 'a.aspect')} AS action
  FROM a JOIN trend ON a.aspect = trend.g LEFT JOIN lists ON lists.aspect = a.aspect""")
def aspect_deep_dive(v):
    return insights.deep_dives(v.scored)


_R = "round_even({}, 1)"


@check("aspect_detail", views="scored", ctes=_dive(6), sql=f"""SELECT a.aspect, round_even(nss, 1) AS nss, "rows",
  round_even(CAST(pos AS DOUBLE) / "rows" * 100, 1) AS pct_positive, round_even(CAST(neu AS DOUBLE) / "rows" * 100, 1) AS pct_neutral,
  round_even(CAST(neg AS DOUBLE) / "rows" * 100, 1) AS pct_negative, direction, round_even(recent_nss, 1) AS recent_nss,
  round_even(prior_nss, 1) AS prior_nss, round_even(delta, 1) AS delta, top_complaints, top_praises,
  {_priority('round_even(nss, 1)')} AS priority, {ACTION_CASE.replace('aspect', 'a.aspect')} AS action
  FROM a JOIN trend ON a.aspect = trend.g LEFT JOIN lists ON lists.aspect = a.aspect""")
def aspect_detail(v):
    return reports.aspect_summaries(v.scored, "aspect", "sentiment")


# the parts of one aspect's detail; the aspect is the one with most texts
_ONE = "one AS (SELECT * FROM scored WHERE aspect = '" + tx.RULE_FALLBACK + "')"


def _part(v, name, aspect=tx.RULE_FALLBACK):
    return reports.aspect_detail(v.scored, aspect)[name]


@check("aspect_detail_yearly", views="scored", ctes=_ONE + f", g AS (SELECT year, {COUNTS} FROM one GROUP BY year HAVING count(*) >= 20)",
       sql=f'SELECT year, "rows", pos, neg, neu, round_even({NSS}, 1) AS nss FROM g')
def aspect_detail_yearly(v):
    return _part(v, "yearly")


@check("aspect_detail_ratings", views="scored", ctes=_ONE,
       sql='SELECT review_rating, count(*) AS "rows" FROM one WHERE review_rating IS NOT NULL GROUP BY review_rating')
def aspect_detail_ratings(v):
    return _part(v, "ratings")


@check("aspect_detail_sources", views="scored", ctes=_ONE + f""", g AS (SELECT source, {COUNTS} FROM one WHERE source IS NOT NULL GROUP BY source
  ORDER BY count(*) DESC, source LIMIT 6)""", sql=f"""SELECT source, "rows", round_even({NSS}, 1) AS nss,
  round_even("rows" / CAST((SELECT count(*) FROM one) AS DOUBLE) * 100, 1) AS pct FROM g""")
def aspect_detail_sources(v):
    return _part(v, "sources")


@check("aspect_detail_samples", views="scored", ctes=_ONE + """, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sentiment
  ORDER BY md5('42:' || review_id), review_id) AS INT) AS rank FROM one WHERE sentiment IN ('Negative', 'Positive'))""",
       sql="""SELECT aspect, sentiment, rank, review_id, substring(review_text, 1, 350) AS text, coalesce(review_rating, 0) AS rating,
  coalesce(source, '') AS source, date FROM r WHERE rank <= 6""")
def aspect_detail_samples(v):
    return _part(v, "samples")


# every aspect of the taxonomy that no text has gets the zero record
@check("aspect_detail_unseen", views="scored", sql="""SELECT 'Unheard' AS aspect, 0.0::DOUBLE AS nss, CAST(count(*) AS BIGINT) AS "rows", 0.0::DOUBLE AS pct_positive,
  0.0::DOUBLE AS pct_neutral, 0.0::DOUBLE AS pct_negative, 'stable' AS direction, 0.0::DOUBLE AS recent_nss, 0.0::DOUBLE AS prior_nss, 0.0::DOUBLE AS delta,
  '' AS top_complaints, '' AS top_praises, 'monitor' AS priority, '' AS action FROM scored WHERE aspect = 'Unheard'""")
def aspect_detail_unseen(v):
    return _part(v, "summary", "Unheard")


_CONTEXT = _dive(5, "context") + """,
  y AS (SELECT aspect, year, count(*) AS r, count(*) FILTER (WHERE sentiment = 'Positive') - count(*) FILTER (WHERE sentiment = 'Negative') AS d
     FROM scored GROUP BY ALL),
  yl AS (SELECT aspect, string_agg(year || ': ' || printf('%+.1f', round_even(CAST(d AS DOUBLE) / r * 100, 1)) || '%', ', ' ORDER BY year) AS yearly_nss FROM y GROUP BY aspect),
  mo AS (SELECT aspect, year_month, count(*) AS r, count(*) FILTER (WHERE sentiment = 'Positive') - count(*) FILTER (WHERE sentiment = 'Negative') AS d
     FROM scored GROUP BY ALL),
  mr AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY year_month DESC) AS k,
     year_month || ': ' || printf('%+.1f', round_even(CAST(d AS DOUBLE) / r * 100, 1)) || '%' AS txt FROM mo),
  ml AS (SELECT aspect, string_agg(txt, ', ' ORDER BY year_month) FILTER (WHERE k <= 12) AS monthly_nss_last12,
     string_agg(txt, ', ' ORDER BY year_month) FILTER (WHERE k <= 6) AS monthly_nss_last6 FROM mr GROUP BY aspect),
  so AS (SELECT aspect, source, count(*) AS r, count(*) FILTER (WHERE sentiment = 'Positive') - count(*) FILTER (WHERE sentiment = 'Negative') AS d
     FROM scored WHERE source IS NOT NULL GROUP BY ALL),
  sl AS (SELECT aspect, string_agg(source || ': NSS ' || printf('%+.1f', round_even(CAST(d AS DOUBLE) / r * 100, 1)) || '% (' || r || ' reviews)', '; ' ORDER BY source) AS sources FROM so GROUP BY aspect),
  li AS (SELECT aspect, bts_line, count(*) AS r, count(*) FILTER (WHERE sentiment = 'Positive') - count(*) FILTER (WHERE sentiment = 'Negative') AS d
     FROM scored WHERE bts_line IS NOT NULL GROUP BY ALL),
  ll AS (SELECT aspect, string_agg(bts_line || ': NSS ' || printf('%+.1f', round_even(CAST(d AS DOUBLE) / r * 100, 1)) || '% (' || r || ' reviews)', '; ' ORDER BY bts_line) AS bts_lines FROM li GROUP BY aspect),
  ra AS (SELECT aspect, review_rating, count(*) AS r FROM scored GROUP BY ALL),
  rl AS (SELECT aspect, string_agg('★' || review_rating || ': ' || r, ', ' ORDER BY review_rating) AS ratings FROM ra GROUP BY aspect),
  ho AS (SELECT aspect, reviewer_hometown, count(*) AS r, row_number() OVER (PARTITION BY aspect ORDER BY count(*) DESC, reviewer_hometown) AS k
     FROM scored WHERE reviewer_hometown IS NOT NULL GROUP BY aspect, reviewer_hometown),
  hl AS (SELECT aspect, string_agg(reviewer_hometown || ' (' || r || ')', ', ' ORDER BY k) AS hometowns FROM ho WHERE k <= 5 GROUP BY aspect),
  av AS (SELECT aspect, round_even(avg(review_rating), 2) AS avg_rating FROM scored GROUP BY aspect),
  tr AS (SELECT g AS aspect, round_even(recent_nss, 1) AS recent_nss, round_even(CASE WHEN months < 2 THEN 0 ELSE prior_nss END, 1) AS prior_nss FROM trend),
  td AS (SELECT *, round_even(recent_nss - prior_nss, 1) AS trend_delta FROM tr),
  ctx AS (SELECT a.aspect, round_even(nss, 1) AS nss, "rows", round_even(CAST(pos AS DOUBLE) / "rows" * 100, 1) AS pct_positive,
    round_even(CAST(neu AS DOUBLE) / "rows" * 100, 1) AS pct_neutral, round_even(CAST(neg AS DOUBLE) / "rows" * 100, 1) AS pct_negative,
    avg_rating, CASE WHEN trend_delta > 5 THEN 'improving' WHEN trend_delta < -5 THEN 'declining' ELSE 'stable' END AS trend_direction,
    trend_delta, recent_nss, prior_nss, coalesce(yearly_nss, '') AS yearly_nss, coalesce(monthly_nss_last12, '') AS monthly_nss_last12,
    coalesce(monthly_nss_last6, '') AS monthly_nss_last6, coalesce(sources, '') AS sources, coalesce(bts_lines, '') AS bts_lines,
    coalesce(ratings, '') AS ratings, coalesce(hometowns, '') AS hometowns, coalesce(top_complaints, '') AS top_complaints,
    coalesce(top_praises, '') AS top_praises, """ + ACTION_CASE.replace("aspect", "a.aspect") + """ AS action
    FROM a LEFT JOIN lists USING (aspect) LEFT JOIN yl USING (aspect) LEFT JOIN ml USING (aspect) LEFT JOIN sl USING (aspect)
    LEFT JOIN ll USING (aspect) LEFT JOIN rl USING (aspect) LEFT JOIN hl USING (aspect) LEFT JOIN av USING (aspect) LEFT JOIN td USING (aspect))"""


@check("aspect_context", views="scored", ctes=_CONTEXT, sql="SELECT * FROM ctx")
def aspect_context(v):
    return retrieval.aspect_contexts(v.scored)


# ---- samples, seeds, conversations -----------------------------------------------------

_DATE = "strftime(created_at_date, '%Y-%m-%d') AS date"


@check("seed_documents", views="scored", sql="""SELECT aspect || '_' || review_id AS id, coalesce(review_text, '') AS document, aspect, sentiment,
  coalesce(source, '') AS source, date, coalesce(review_rating, 0) AS rating FROM scored
  WHERE sentiment IN ('Negative', 'Positive') AND aspect IS NOT NULL""")
def seed_documents(v):
    return retrieval.seed_documents(v.scored)


@check("document_upsert", views="scored", ctes="""n AS (SELECT aspect || '_' || review_id AS id, coalesce(review_text, '') AS document, aspect, sentiment,
    coalesce(source, '') AS source, date, review_rating AS rating FROM scored WHERE sentiment IN ('Negative', 'Positive')),
  o AS (SELECT aspect || '_' || review_id AS id, 'old' AS document, aspect, sentiment, coalesce(source, '') AS source, date, review_rating AS rating
    FROM scored WHERE sentiment <> 'Positive')""",
       sql="SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def document_upsert(v):
    old = v.scored.filter("sentiment <> 'Positive'").select(
        F.concat_ws("_", "aspect", "review_id").alias("id"), F.lit("old").alias("document"), "aspect", "sentiment",
        F.coalesce("source", F.lit("")).alias("source"), "date", F.col("review_rating").alias("rating"))
    return caches.merge_documents(old, retrieval.seed_documents(v.scored), force=True)


@check("aspect_samples", views="scored", ctes="""h AS (SELECT *, md5('42:' || review_id) AS h FROM scored WHERE sentiment IN ('Negative', 'Positive')),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY aspect, sentiment ORDER BY h, review_id) AS INT) AS rank FROM h)""",
       sql="""SELECT aspect, sentiment, rank, review_id, substring(review_text, 1, 400) AS text, coalesce(review_rating, 0) AS rating,
  coalesce(source, '') AS source, date FROM r WHERE rank <= 8""")
def aspect_samples(v):
    return retrieval.samples(v.scored)


@check("conversation_tail", ctes="""r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)""",
       sql="SELECT conv_id, turn, role, text FROM r WHERE k <= 6")
def conversation_tail(v):
    return retrieval.conversation_tail(v.table("conversations"))


def known_sql(text):
    q = f"lower({text})"
    return f"""CASE WHEN {q} LIKE '%accessibility%' THEN 'Accessibility' WHEN {q} LIKE '%cleanliness%' THEN 'Cleanliness'
  WHEN {q} LIKE '%crowding%' OR {q} LIKE '%comfort%' THEN 'Crowding & Comfort'
  WHEN {q} LIKE '%fare%' OR {q} LIKE '%payment%' OR {q} LIKE '%system%' THEN 'Fare & Payment System'
  WHEN {q} LIKE '%information%' OR {q} LIKE '%navigation%' THEN 'Information & Navigation'
  WHEN {q} LIKE '%overall%' OR {q} LIKE '%experience%' OR {q} LIKE '%convenience%' THEN 'Overall Experience & Convenience'
  WHEN {q} LIKE '%route%' OR {q} LIKE '%coverage%' OR {q} LIKE '%connectivity%' THEN 'Route Coverage & Connectivity'
  WHEN {q} LIKE '%safety%' OR {q} LIKE '%security%' THEN 'Safety & Security'
  WHEN {q} LIKE '%staff%' OR {q} LIKE '%service%' THEN 'Staff & Service'
  WHEN {q} LIKE '%train%' OR {q} LIKE '%frequency%' OR {q} LIKE '%waiting%' OR {q} LIKE '%time%' THEN 'Train Frequency & Waiting Time' END"""


@check("question_aspect", sql=f"SELECT conv_id, turn, {known_sql('text')} AS aspect FROM conversations")
def question_aspect(v):
    return retrieval.with_question_aspect(v.table("conversations"), "text").select("conv_id", "turn", "aspect")


@check("cache_file_name", views="scored",
       sql="SELECT DISTINCT aspect, replace(replace(replace(aspect, '/', '_'), ' ', '_'), '&', 'and') AS file_name FROM scored")
def cache_file_name(v):
    return v.scored.select("aspect", ex.cache_name(F.col("aspect")).alias("file_name")).distinct()


# ---- retrieval -------------------------------------------------------------------------

_NEAREST = """ne AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  ns AS (SELECT q.vec_id AS query_id, d.vec_id AS document_id, round(list_cosine_similarity(q.e, d.e), 12) AS score FROM ne q, ne d WHERE q.vec_id <> d.vec_id),
  nk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INT) AS rank FROM ns)"""


def _near(v, **kw):
    e = v.table("embeddings")
    return retrieval.nearest(e, e, 8, "vec_id", "vec_id", include_self=False, **kw)


@check("cosine_topk", ctes=_NEAREST, sql="SELECT query_id, document_id, rank, round(score, 6) AS score FROM nk WHERE rank <= 8")
def cosine_topk(v):
    return rounded(_near(v), "score")


@check("cosine_topk_blocked", ctes=_NEAREST, sql="SELECT query_id, document_id, rank, round(score, 6) AS score FROM nk WHERE rank <= 8")
def cosine_topk_blocked(v):
    return rounded(_near(v, query_bytes=0), "score")


@check("cosine_topk_indexed", ctes=_NEAREST, sql="SELECT query_id, document_id, rank, round(score, 6) AS score FROM nk WHERE rank <= 8 AND query_id % 50 = 0")
def cosine_topk_indexed(v):
    """Every vector is listed; queries are those whose id is divisible by 50."""
    e = v.table("embeddings")
    index = vector_index.VectorIndex.build(e, "vec_id")
    return rounded(index.search(e.filter("vec_id % 50 = 0"), 8, "vec_id", include_self=False), "score")


def _chunks(v):
    meta = v.scored.select(F.col("id").alias("document_id"), F.coalesce("review_text", F.lit("")).alias("text"), "aspect",
                           "sentiment", "date", F.coalesce("source", F.lit("")).alias("source"))
    return scaling.join_hot_keys(_near(v), meta, "document_id", "inner").withColumnRenamed("query_id", "question_id")


_CHUNKS = _NEAREST + """, ch AS (SELECT query_id AS question_id, rank, coalesce(review_text, '') AS text, aspect, sentiment, date,
  coalesce(source, '') AS source FROM nk JOIN scored ON scored.id = nk.document_id WHERE rank <= 8)"""


@check("retrieved_chunks", views="scored", ctes=_CHUNKS, sql="SELECT * FROM ch")
def retrieved_chunks(v):
    return _chunks(v).select("question_id", "rank", "text", "aspect", "sentiment", "date", "source")


def _or_missing(c):
    return f"CASE WHEN {c} = '' THEN 'N/A' ELSE {c} END"


_STATS = "'Live statistics for **' || aspect || '**:' || chr(10) || " + " || chr(10) || ".join([
    "'- NSS: ' || nss || '% | Volume: ' || \"rows\" || ' reviews'",
    "'- Positive: ' || pct_positive || '% | Neutral: ' || pct_neutral || '% | Negative: ' || pct_negative || '%'",
    "'- Trend: ' || trend_direction || ' (' || printf('%+.1f', trend_delta) || 'pp) | Recent NSS: ' || recent_nss || '% | Prior NSS: ' || prior_nss || '%'",
    "'- Year-over-year NSS: ' || yearly_nss", "'- Monthly NSS (last 6 months): ' || monthly_nss_last6", "'- By source: ' || sources",
    f"'- By BTS line: ' || {_or_missing('bts_lines')}", "'- Avg rating: ' || avg_rating || ' | Rating dist: ' || ratings",
    f"'- Top reviewer hometowns: ' || {_or_missing('hometowns')}", "'- Top negative phrases: ' || top_complaints",
    "'- Top positive phrases: ' || top_praises", "'- Recommended action: ' || action"])


@check("question_sources", views="scored", ctes=_CHUNKS,
       sql="SELECT question_id, rank, substring(text, 1, 200) AS text, aspect, sentiment, date, source FROM ch")
def question_sources(v):
    return retrieval.question_sources(_chunks(v))


def _no_statistics(aspect):
    actions = " ".join(f"WHEN '{a}' THEN '{text}'" for a, text in tx.ACTIONS.items())
    block = tx.NO_STATISTICS.replace("{aspect}", f"' || {aspect} || '").replace("{action}", f"' || CASE {aspect} {actions} ELSE '' END || '")
    return f"'{block}'"


@check("context_text", views="scored", ctes=_CHUNKS + ", " + _CONTEXT + f""", st AS (SELECT aspect, {_STATS} AS statistics FROM ctx),
  qu AS (SELECT e.vec_id AS question_id, review_text AS question, {known_sql('review_text')} AS named FROM embeddings e JOIN scored ON scored.id = e.vec_id),
  ex AS (SELECT question_id, string_agg('[' || aspect || ' | ' || sentiment || ' | ' || date || ' | ' || source || ']' || chr(10) || text,
     chr(10) || chr(10) ORDER BY rank) AS excerpts FROM ch GROUP BY question_id),
  vo AS (SELECT question_id, aspect AS voted, row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, min(rank)) AS k FROM ch GROUP BY question_id, aspect),
  al AS (SELECT qu.question_id, question, coalesce(named, voted) AS aspect, excerpts FROM qu LEFT JOIN ex USING (question_id) LEFT JOIN (SELECT * FROM vo WHERE k = 1) USING (question_id))""",
       sql="""SELECT question_id, al.aspect, 'Question: ' || question || chr(10) || chr(10) || 'Retrieved reviews:' || chr(10) || coalesce(excerpts, '')
  || chr(10) || coalesce(chr(10) || coalesce(statistics, """ + _no_statistics("al.aspect") + """) || chr(10), '') AS context
  FROM al LEFT JOIN st ON st.aspect = al.aspect""")
def context_text(v):
    questions = v.table("embeddings").select(F.col("vec_id").alias("question_id")).join(
        v.scored.select(F.col("id").alias("question_id"), F.col("review_text").alias("question")), "question_id")
    return reports.question_contexts(v.scored, questions, _chunks(v))

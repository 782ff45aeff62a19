"""Review tables derived from the given test tables, for Spark and as SQL for the oracle.

The statements are shared text; only table names and the keyword-rule test differ by engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tonecast import taxonomy as tx
from tonecast.operators import cleaning, scaling

REVIEWS = """
WITH base AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS review_id,
         CASE p.p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2
                       WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 ELSE 5 END AS k,
         p.p_type AS aspect,
         n.n_name AS src, l_shipdate AS created_at_date, l_linestatus,
         CAST(1 + CAST(l_quantity AS INT) % 5 AS INT) AS review_rating,
         CAST(year(l_shipdate) AS INT) AS yr,
         (l_orderkey*31 + l_linenumber*17 + l_suppkey*13) % 100 AS h1,
         (l_partkey*29 + l_suppkey*41 + l_linenumber*53) % 100 AS h2,
         (l_partkey*19 + l_orderkey*7) % 660 AS h3
  FROM {lineitem} l
  JOIN {part} p ON l.l_partkey = p.p_partkey
  JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN {nation} n ON s.s_nationkey = n.n_nationkey
), cut AS (
  SELECT *, 15 + 15*k + CASE k % 3 WHEN 0 THEN (yr-1998)*2 WHEN 1 THEN (1998-yr)*2 ELSE 0 END AS pos_cut,
            100 - (65 - 12*k) AS neg_cut
  FROM base
), lab AS (
  SELECT *, CASE WHEN h1 < pos_cut THEN 'Positive' WHEN h1 >= neg_cut THEN 'Negative' ELSE 'Neutral' END AS sentiment
  FROM cut
)
SELECT review_id, review_rating,
       CASE WHEN h2 = 7 THEN NULL ELSE src END AS source,
       created_at_date,
       CASE WHEN h2 % 10 = 3 THEN NULL WHEN l_linestatus = 'F' THEN 'Sukhumvit' ELSE 'Silom' END AS bts_line,
       aspect, sentiment,
       CASE WHEN h2 % 20 < 7 THEN aspect WHEN h2 % 2 = 0 THEN 'ECONOMY' ELSE 'LARGE' END AS aspect_pred,
       CASE WHEN h2 < 82 THEN sentiment
            WHEN sentiment = 'Positive' THEN CASE WHEN h2 % 3 = 0 THEN 'Negative' ELSE 'Neutral' END
            WHEN sentiment = 'Negative' THEN CASE WHEN h2 % 3 = 0 THEN 'Positive' ELSE 'Neutral' END
            ELSE CASE WHEN h2 % 2 = 0 THEN 'Positive' ELSE 'Negative' END END AS sentiment_pred,
       0.34 + CAST(h3 AS DOUBLE)/1000 AS sentiment_confidence
FROM lab
"""

TEXTS = """
SELECT CAST(d.doc_id AS VARCHAR(20)) AS review_id, d.doc_id AS id, d.text AS review_text,
       CAST(1 + d.doc_id % 5 AS INT) AS review_rating, d.source, d.lang,
       DATE '2012-01-01' + CAST((d.doc_id*37) % 5000 AS INT) AS created_at_date,
       CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive'
            WHEN l.quality = 0 THEN 'Neutral' END AS sentiment
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

# every text with an aspect, a sentiment (from the rating where no label exists) and a prediction
SCORED = """
SELECT review_id, id, review_text, review_rating, source, created_at_date,
       CASE WHEN id % 10 = 3 THEN NULL WHEN id % 2 = 0 THEN 'Sukhumvit' ELSE 'Silom' END AS bts_line,
       CASE WHEN id % 7 = 0 THEN NULL ELSE concat(lang, '-', CAST(id % 9 AS VARCHAR(2))) END AS reviewer_hometown,
       aspect, sentiment,
       CASE WHEN id % 3 = 0 THEN 'Crowding & Comfort' ELSE aspect END AS aspect_pred,
       CASE WHEN id % 5 < 4 THEN sentiment WHEN sentiment = 'Positive' THEN 'Neutral'
            WHEN sentiment = 'Neutral' THEN 'Negative' ELSE 'Positive' END AS sentiment_pred,
       0.34 + CAST((id*37) % 660 AS DOUBLE)/1000 AS sentiment_confidence
FROM (SELECT review_id, id, review_text, review_rating, source, lang, created_at_date, aspect,
             coalesce(sentiment, CASE WHEN review_rating >= 4 THEN 'Positive' WHEN review_rating = 3 THEN 'Neutral'
                                      ELSE 'Negative' END) AS sentiment
      FROM {ruled} t) u
"""

# raw labels with aliases, pseudo labels, padding and mixed date texts
RAW = """
SELECT review_id, review_text, review_rating, source, lang AS reviewer_hometown,
       CASE WHEN id % 10 = 3 THEN NULL ELSE 'Silom' END AS bts_line,
       CASE id % 6 WHEN 0 THEN day_text WHEN 1 THEN concat(day_text, ' 10:20:30')
            WHEN 2 THEN concat(substring(day_text, 6, 2), '/', substring(day_text, 9, 2), '/', substring(day_text, 1, 4))
            WHEN 3 THEN concat(day_text, 'T08:09:10') WHEN 4 THEN replace(day_text, '-', '/')
            ELSE 'last week' END AS created_at_date,
       CASE id % 16 WHEN 0 THEN ' Staff quality' WHEN 1 THEN 'Facilities ' WHEN 2 THEN 'Cleanliness'
            WHEN 3 THEN 'Punctuality' WHEN 4 THEN 'Safety' WHEN 5 THEN 'Price fairness' WHEN 6 THEN 'Irrelevant'
            WHEN 7 THEN 'Positive' WHEN 8 THEN 'Overall Experience' WHEN 9 THEN 'Data availability'
            WHEN 10 THEN 'Crowding & Comfort' WHEN 11 THEN 'Unknown label' WHEN 12 THEN NULL
            WHEN 13 THEN 'Infrastructure & Facilities' WHEN 14 THEN 'Negative' ELSE 'Convenience' END AS aspect,
       CASE id % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN ' Negative ' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'Mixed'
            ELSE 'Positive' END AS sentiment
FROM (SELECT *, CAST(created_at_date AS VARCHAR(10)) AS day_text FROM ({texts}) t) u
"""

# class probabilities: the confidence goes to the prediction, the rest is shared by the other two
PROBS = """
SELECT review_id, sentiment,
       CASE sentiment_pred WHEN 'Negative' THEN c WHEN 'Positive' THEN (1 - c) * w ELSE (1 - c) * (1 - w) END AS p_negative,
       CASE sentiment_pred WHEN 'Neutral' THEN c WHEN 'Negative' THEN (1 - c) * w ELSE (1 - c) * (1 - w) END AS p_neutral,
       CASE sentiment_pred WHEN 'Positive' THEN c WHEN 'Neutral' THEN (1 - c) * w ELSE (1 - c) * (1 - w) END AS p_positive
FROM (SELECT review_id, sentiment, sentiment_pred, sentiment_confidence AS c, 3e-1 + 5e-2 * review_rating AS w
      FROM ({reviews}) r) u
"""

# explicit schemas spare a footer scan per table
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_type string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "documents": "doc_id bigint, text string, lang string, source string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = ("lineitem", "part", "supplier", "nation", "documents", "labels")
_CALENDAR = ("strftime(created_at_date, '%Y-%m') AS year_month, CAST(year(created_at_date) AS INT) AS year, "
             "CAST(month(created_at_date) AS INT) AS month, strftime(created_at_date, '%Y-%m-%d') AS date")


def rule_case(test: str, text: str = "review_text", fallback: str = tx.RULE_FALLBACK) -> str:
    """Keyword rules as a CASE expression; ``test`` is a pattern with places for text and regex."""
    arms = " ".join(f"WHEN {test.format(text=f'lower({text})', regex=regex)} THEN '{name}'" for name, regex in tx.ASPECT_RULES)
    return f"CASE {arms} ELSE '{fallback}' END"


DUCK_TEST = "regexp_matches({text}, '{regex}')"


def _fill(sql: str, tables: dict[str, str]) -> str:
    reviews, texts = REVIEWS.format(**tables), TEXTS.format(**tables)
    ruled = f"(SELECT *, {rule_case(DUCK_TEST)} AS aspect FROM ({texts}) x)"
    return sql.format(**tables, texts=texts, reviews=reviews, ruled=ruled)


def oracle_views() -> dict[str, str]:
    """CTE bodies for the oracle, with calendar columns on the review tables."""
    tables = {t: t for t in TABLES}
    views = {name: _fill(sql, tables) for name, sql in
             [("reviews", REVIEWS), ("texts", TEXTS), ("scored", SCORED), ("raw", RAW), ("probs", PROBS)]}
    for name in ("reviews", "scored"):
        views[name] = f"SELECT *, {_CALENDAR} FROM ({views[name]}) v"
    return views


class Views:
    """The derived tables of one scale factor as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def labelled_rows(self) -> DataFrame:
        # a single small file is spread over the cores first
        lineitem = scaling.spread_small_input(self.table("lineitem"), "l_orderkey")
        return self.spark.sql(REVIEWS, lineitem=lineitem, **{t: self.table(t) for t in ("part", "supplier", "nation")})

    @cached_property
    def reviews(self) -> DataFrame:
        return cleaning.with_calendar(self.labelled_rows)

    @cached_property
    def texts(self) -> DataFrame:
        # text work is costly per row, so a single small file is spread over the cores first
        documents = scaling.spread_small_input(self.table("documents"), "doc_id")
        tables = {"documents": documents, "labels": self.table("labels")}
        return self.spark.sql(TEXTS, **tables)

    def _scored(self, batched: bool) -> DataFrame:
        ruled = cleaning.with_rule_aspect(self.texts, "aspect", batched=batched)
        return cleaning.with_calendar(self.spark.sql(SCORED, ruled=ruled))

    @cached_property
    def scored(self) -> DataFrame:
        return self._scored(False)

    @cached_property
    def scored_batched(self) -> DataFrame:
        """The same rows, for queries that run Python in their tasks anyway."""
        return self._scored(True)

    @cached_property
    def raw(self) -> DataFrame:
        return self.spark.sql(RAW.replace("({texts})", "{texts}"), texts=self.texts)

    @cached_property
    def probs(self) -> DataFrame:
        return self.spark.sql(PROBS.replace("({reviews})", "{reviews}"), reviews=self.labelled_rows)

"""Label cleaning, aspect assignment and derived review columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonecast import taxonomy as tx
from tonecast.functions import expressions as ex
from tonecast.operators import scaling
from tonecast.schema import SENTIMENTS


def _mapped(c: Column, mapping: dict[str, str]) -> Column:
    """Value looked up in a small constant map, null when absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), c)


def clean_labels(df: DataFrame) -> DataFrame:
    """Trim labels, keep the three sentiments, map aspects to the 13-name taxonomy, add ``text_id``.

    The mapping is a constant expression, so cleaning is one map-only stage.
    """
    mapping = {**{a: a for a in tx.CANONICAL_ASPECTS}, **tx.CANONICAL_ALIASES}
    return (df.withColumns({"sentiment": ex.strip(F.col("sentiment")), "aspect_raw": ex.strip(F.col("aspect"))})
            .filter(F.col("sentiment").isin(*SENTIMENTS) & ~F.col("aspect_raw").isin(*tx.PSEUDO_ASPECTS))
            .withColumn("aspect", _mapped(F.col("aspect_raw"), mapping))
            .filter(F.col("aspect").isin(*tx.CANONICAL_ASPECTS))
            .withColumn("text_id", ex.text_id(F.col("review_text"))))


def prepare_cleaned(df: DataFrame) -> DataFrame:
    """Label checks of an already merged table (10-name taxonomy) plus ``text_id``."""
    return (df.withColumns({"sentiment": ex.strip(F.col("sentiment")), "aspect": ex.strip(F.col("aspect"))})
            .filter(F.col("sentiment").isin(*SENTIMENTS) & F.col("aspect").isin(*tx.MERGED_ASPECTS))
            .withColumn("text_id", ex.text_id(F.col("review_text"))))


def merge_labels(df: DataFrame) -> DataFrame:
    """Replace near-duplicate aspect names; unknown names stay as they are."""
    return df.withColumn("aspect", F.coalesce(_mapped(F.col("aspect"), tx.MERGED_ALIASES), F.col("aspect")))


def with_rule_aspect(df: DataFrame, name: str = "aspect_pred", fallback: str = tx.RULE_FALLBACK,
                     batched: bool = False) -> DataFrame:
    """Keyword-rule aspect of the review text; ``batched`` finds it on Arrow batches, where Python runs in the tasks anyway."""
    rule = ex.first_rule if batched else ex.first_rule_plain
    return df.withColumn(name, rule(F.col("review_text"), tx.ASPECT_RULES, fallback))


def reassign_pseudo(df: DataFrame, keep_off_topic: bool = False) -> DataFrame:
    """Give rows with a pseudo label a keyword aspect; drop what stays off topic."""
    ruled = ex.first_rule_plain(F.col("review_text"), tx.ASPECT_RULES, tx.OFF_TOPIC)
    out = df.withColumn("aspect", F.when(F.col("aspect").isin(*tx.PSEUDO_ASPECTS), ruled).otherwise(F.col("aspect")))
    if keep_off_topic:
        return out
    return out.filter(F.coalesce(F.col("aspect") != tx.OFF_TOPIC, F.lit(True)))


def clean_reviews(df: DataFrame) -> DataFrame:
    """Merge labels, re-assign pseudo labels, drop off-topic rows."""
    return reassign_pseudo(merge_labels(df))


def with_dates(df: DataFrame, column: str = "created_at_date") -> DataFrame:
    """Parse mixed date texts and drop rows without a usable date."""
    # exploding none or one parsed value drops bad rows and parses each text once; a filter would be
    # pushed below the projection and repeat all formats
    parsed = F.filter(F.array(ex.lenient_timestamp(F.col(column))), lambda t: t.isNotNull())
    return df.withColumn(column, F.explode(parsed))


def drop_months(df: DataFrame, months: tuple[tuple[int, int], ...], column: str = "created_at_date") -> DataFrame:
    """Leave out months known to carry collection dates instead of review dates."""
    return df.filter(~ex.in_months(F.col(column), months)) if months else df


def with_calendar(df: DataFrame, column: str = "created_at_date") -> DataFrame:
    c = F.col(column)
    return df.withColumns({
        "year_month": F.substring(c.cast("date").cast("string"), 1, 7), "year": F.year(c), "month": F.month(c),
        "date": c.cast("date").cast("string"),
    })


def with_lengths(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("review_text"), F.lit(""))
    return df.withColumns({"text_length": F.char_length(text), "word_count": ex.word_count(F.col("review_text"))})


def dashboard_table(df: DataFrame, corrupt_months: tuple[tuple[int, int], ...] = ((2026, 4),)) -> DataFrame:
    """Scored reviews with parsed dates, without the corrupt month, with calendar and length columns."""
    return with_lengths(with_calendar(drop_months(with_dates(df), corrupt_months)))


def first_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Row cap under an explicit key, since files have no order here; large caps never meet in one task."""
    return scaling.first_in_order(df, n, list(keys))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "review_id") -> DataFrame:
    return scaling.hash_sample(df, n, ex.seeded_hash(seed, F.col(key)), F.col(key))


def project_known(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[c for c in columns if c in df.columns])


def label_distribution(df: DataFrame, column: str = "aspect") -> DataFrame:
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), column))

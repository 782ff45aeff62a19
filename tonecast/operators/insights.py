"""Priorities, recommended actions, insight cards and the executive view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonecast import taxonomy as tx
from tonecast.functions import expressions as ex
from tonecast.operators import phrases, tallies, trends

NO_VALUE = "—"


@dataclass(frozen=True)
class Thresholds:
    pain_nss: float = -20.0
    pain_rows: int = 500
    strength_nss: float = 60.0
    strength_rows: int = 1000
    low_confidence: float = 0.5
    low_confidence_pct: float = 10.0
    agreement_pct: float = 50.0


DEFAULT = Thresholds()


def priority(nss: Column, rows: Column, t: Thresholds = DEFAULT) -> Column:
    return (F.when((nss < t.pain_nss) & (rows >= t.pain_rows), "urgent")
            .when((nss >= t.strength_nss) & (rows >= t.strength_rows), "leverage").otherwise("monitor"))


def lookup(keys: Column, table: dict[str, str], default: Column) -> Column:
    """Value of a small constant table, else ``default``."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), keys), default)


def action(aspect: Column) -> Column:
    return lookup(aspect, tx.ACTIONS, F.format_string(tx.ACTION_TEMPLATE, aspect))


def card_advice(aspect: Column, severity: Column) -> Column:
    """Advice by aspect and severity, else the template of the severity."""
    joined = F.concat_ws("|", aspect, severity)
    general = lookup(severity, tx.CARD_ADVICE_TEMPLATES, F.lit(None).cast("string"))
    return lookup(joined, {f"{a}|{s}": text for (a, s), text in tx.CARD_ADVICE.items()},
                  F.replace(general, F.lit("%s"), aspect))


def priorities(df: DataFrame, aspect: str = "aspect", sentiment: str = "sentiment", round_first: bool = False,
               t: Thresholds = DEFAULT) -> DataFrame:
    """Priority per aspect; ``round_first`` rounds the score to one place before the rule."""
    table = tallies.nss_table(df.withColumn("aspect", F.col(aspect)), "aspect", sentiment=sentiment)
    score = F.bround("nss", 1) if round_first else F.col("nss")
    return table.select("aspect", "rows", score.alias("nss"), priority(score, F.col("rows"), t).alias("priority"))


def executive_summary(df: DataFrame, aspect: str = "aspect", sentiment: str = "sentiment") -> DataFrame:
    """One row: score, volume, date range, worst and best aspect, trend and headline.

    One pass over the reviews counts per aspect and month; all parts derive from that small table.
    """
    s = F.col(sentiment)
    cells = df.groupBy(F.col(aspect).alias("a"), "year_month").agg(
        F.count(F.lit(1)).alias("rows"), ex.is_label(s, "Positive").alias("pos"), ex.is_label(s, "Negative").alias("neg"),
        F.min("created_at_date").alias("first"), F.max("created_at_date").alias("last"))
    # aspects times months: a calendar-sized table, ranked as a whole
    everything = Window.partitionBy(F.lit(0))
    per_aspect = Window.partitionBy("a")
    of_aspect = ex.nss(F.sum("pos").over(per_aspect), F.sum("neg").over(per_aspect), F.sum("rows").over(per_aspect))
    placed = cells.withColumn("nss", F.when(F.col("a").isNotNull(), of_aspect))
    placed = placed.withColumn("i", F.dense_rank().over(everything.orderBy(F.asc_nulls_last("year_month"))))
    placed = placed.withColumn("n", F.max(F.when(F.col("year_month").isNotNull(), F.col("i"))).over(everything))
    known, half = F.col("year_month").isNotNull(), F.floor(F.col("n") / 2)

    def pooled(condition: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    early, late = known & (F.col("i") <= half), known & (F.col("i") > half)
    bad, good = F.col("nss") < 0, F.col("nss") > 0
    t = placed.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("last"), "yyyy-MM-dd").alias("last"),
        F.coalesce(F.max("n"), F.lit(0)).alias("months"),
        ex.nss(pooled(late, "pos"), pooled(late, "neg"), pooled(late, "rows")).alias("recent"),
        ex.nss(pooled(early, "pos"), pooled(early, "neg"), pooled(early, "rows")).alias("prior"),
        F.coalesce(F.min_by(F.when(bad, F.col("a")), F.when(bad, F.struct("nss", "a"))), F.lit(NO_VALUE)).alias("top_pain"),
        F.coalesce(F.min_by(F.when(good, F.col("a")), F.when(good, F.struct(-F.col("nss"), F.col("a")))),
                   F.lit(NO_VALUE)).alias("top_strength"))
    direction = F.when(F.col("months") < 2, "stable").otherwise(trends.direction(F.col("recent") - F.col("prior")))
    out = t.select(
        ex.nss(F.col("pos"), F.col("neg"), F.col("rows")).alias("overall_nss"), F.col("rows").alias("total_reviews"),
        F.when(F.col("rows") > 0, F.concat("first", F.lit(" → "), "last")).otherwise(NO_VALUE).alias("date_range"),
        "top_pain", "top_strength", direction.alias("trend_direction"))
    words = lookup(F.col("trend_direction"), tx.TREND_WORDS, F.lit(""))
    headline = F.concat(F.lit("Overall sentiment is "), words, F.lit(" (NSS "),
                        ex.signed_percent(F.bround("overall_nss", 2)), F.lit("%). "), F.col("top_strength"),
                        F.lit(" is a standout strength; "), F.col("top_pain"), F.lit(" demands immediate action."))
    return out.withColumn("headline", F.when(F.col("total_reviews") > 0, headline).otherwise("No data."))


def phrase_lists(df: DataFrame, aspect: str, sentiment: str, n: int, variant: str, max_texts: int | None) -> DataFrame:
    """Top complaint and praise phrases per aspect, each as one comma-separated text in rank order."""
    sides = df.filter(F.col(sentiment).isin("Positive", "Negative")).withColumns(
        {"aspect": F.col(aspect), "side": F.col(sentiment)})
    top = phrases.top_phrases_by(sides, ["aspect", "side"], n, variant=variant, max_texts=max_texts)

    def joined(side: str) -> Column:
        ranked = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "ngram"))))
        return F.array_join(F.transform(ranked, lambda x: x["ngram"]), ", ")

    return top.groupBy("aspect").agg(joined("Negative").alias("top_complaints"), joined("Positive").alias("top_praises"))


def deep_dives(df: DataFrame, aspect: str = "aspect", sentiment: str = "sentiment", n_phrases: int = 5,
               max_texts: int | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """All aspects at once: shares, trend, priority, action and phrases; urgent first, then by rounded score."""
    base = df.withColumn("aspect", F.col(aspect))
    table = tallies.score(trends.movement(base, "aspect", sentiment))
    texts = phrase_lists(base, "aspect", sentiment, n_phrases, "business", max_texts)
    out = (table.join(texts, "aspect", "left")
           .withColumn("priority", priority(F.col("nss"), F.col("rows"), t)))
    order = F.array_position(F.array(F.lit("urgent"), F.lit("monitor"), F.lit("leverage")), F.col("priority"))
    return out.select(
        "aspect", "nss", "rows", "pct_negative", ex.share(F.col("pos"), F.col("rows")).alias("pct_positive"),
        F.coalesce("top_complaints", F.lit("")).alias("top_complaints"),
        F.coalesce("top_praises", F.lit("")).alias("top_praises"),
        "direction", "recent_nss", "prior_nss", "delta", "priority", action(F.col("aspect")).alias("action"),
    ).orderBy(order, F.bround("nss", 1), "aspect")


def insight_cards(df: DataFrame, aspect: str = "aspect", sentiment: str = "sentiment", model_quality: bool = True,
                  t: Thresholds = DEFAULT) -> DataFrame:
    """Rule-driven cards in display order: pains, strengths, then model warnings.

    Model quality is counted in the same pass per aspect and summed over the aspect table.
    """
    counted = tallies.counts(sentiment)
    if model_quality:
        counted += [F.count_if(ex.equal(F.col("aspect"), F.col("aspect_pred"))).alias("agreed"),
                    F.count_if(F.col("sentiment_confidence") < t.low_confidence).alias("unsure")]
    table = tallies.score(df.groupBy(F.col(aspect).alias("a")).agg(*counted))
    nss, rows, severity = F.col("nss"), F.col("rows"), F.col("severity")
    pain = F.col("a").isNotNull() & (nss < t.pain_nss) & (rows >= t.pain_rows)
    strength = F.col("a").isNotNull() & (nss >= t.strength_nss) & (rows >= t.strength_rows)
    table = table.withColumns({"severity": F.when(pain, "critical").when(strength, "good"),
                               "signed": ex.signed_percent(nss)})
    lead = F.concat(F.lit("NSS = "), F.col("signed"), F.lit("% across "), rows.cast("string"), F.lit(" reviews — "))
    negative = F.format_string("%.0f", F.bround("pct_negative", 0))
    bad = severity == "critical"
    cards = [F.when(severity.isNotNull(), _card(
        F.when(bad, 1).otherwise(2), F.when(bad, nss).otherwise(-nss),
        F.concat(F.when(bad, "Critical pain: ").otherwise("Strength to amplify: "), F.col("a")),
        F.when(bad, F.concat(lead, negative, F.lit("% are negative.")))
        .otherwise(F.concat(lead, F.lit("riders consistently praise this."))),
        card_advice(F.col("a"), severity), severity, F.concat(F.lit("NSS "), F.col("signed"), F.lit("%"))))]
    if model_quality:
        everything = Window.partitionBy(F.lit(0))  # one row per aspect
        total = F.sum("rows").over(everything)
        table = table.withColumns({
            "first": F.row_number().over(everything.orderBy("a")) == 1,
            "agree": F.sum("agreed").over(everything) / total * 100, "low": F.sum("unsure").over(everything) / total * 100})
        cards += _model_cards(t)
    return table.select(F.inline(F.array_compact(F.array(*cards)))).orderBy("section", "position", "title")


def _card(section: Column, position: Column, title: Column, finding: Column, recommendation: Column, severity: Column,
          metric: Column) -> Column:
    return F.struct(section.alias("section"), position.alias("position"), title.alias("title"), finding.alias("finding"),
                    recommendation.alias("recommendation"), severity.alias("severity"), metric.alias("metric"))


def _model_cards(t: Thresholds) -> list[Column]:
    """Warnings on weak aspect agreement and on low confidence, shown on the first aspect row only."""
    agree, low = F.bround("agree", 1), F.bround("low", 1)
    texts = [
        (3, tx.AGREEMENT_CARD, F.format_string(tx.AGREEMENT_CARD["finding"], agree), "warning",
         F.format_string("Agreement %.1f%%", agree), F.col("agree") < t.agreement_pct),
        (4, tx.CONFIDENCE_CARD, F.format_string(tx.CONFIDENCE_CARD["finding"], low, F.lit(t.low_confidence)), "info",
         F.format_string("Low-conf %.1f%%", low), F.col("low") > t.low_confidence_pct)]
    return [F.when(F.col("first") & shown, _card(
        F.lit(section), F.lit(0.0), F.lit(words["title"]), finding, F.lit(words["recommendation"]), F.lit(severity), metric))
        for section, words, finding, severity, metric, shown in texts]

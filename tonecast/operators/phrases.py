"""Word and phrase statistics of review texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonecast.functions import tokens as tk
from tonecast.operators import frequent, scaling


def _by_count(*names: str) -> list[Column]:
    return [F.desc("count"), *[F.asc(n) for n in names]]


def word_counts(df: DataFrame, *keys: str, variant: str = "plain", text: str = "review_text") -> DataFrame:
    exploded = df.select(*keys, F.explode(tk.words(F.col(text), variant)).alias("term"))
    return exploded.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("count"))


def vocabulary_size(df: DataFrame, variant: str = "plain") -> DataFrame:
    """Total tokens and distinct tokens; counting per word first avoids a distinct shuffle of tokens."""
    return word_counts(df, variant=variant).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"),
                                                F.count(F.lit(1)).alias("vocabulary"))


def top_terms(df: DataFrame, n: int = 30, variant: str = "plain") -> DataFrame:
    """Most frequent words with their weight relative to the first."""
    top = word_counts(df, variant=variant).orderBy(*_by_count("term")).limit(n)
    peak = F.max("count").over(Window.partitionBy(F.lit(0)))  # over the n rows left
    return top.select("term", "count", (F.col("count") / peak).alias("weight")).orderBy(*_by_count("term"))


def top_terms_by_polarity(df: DataFrame, n: int = 20, variant: str = "plain", sentiment: str = "sentiment") -> DataFrame:
    """Most frequent words of positive rows and of all other rows (counted as negative)."""
    side = F.when(F.coalesce(F.col(sentiment) == "Positive", F.lit(False)), "Positive").otherwise("Negative")
    table = word_counts(df.withColumn("polarity", side), "polarity", variant=variant)
    return scaling.first_per_group(table, ["polarity"], _by_count("term"), n)


def cap_texts(df: DataFrame, keys: list[str], max_texts: int | None, order: str = "review_id") -> DataFrame:
    """At most ``max_texts`` texts per group in key order; without a cap all texts count."""
    if max_texts is None:
        return df
    return scaling.first_per_group(df, keys, [F.asc(order)], max_texts, "_rank").drop("_rank")


def phrase_arrays(df: DataFrame, *keys: str, lo: int = 2, hi: int = 2, variant: str = "voice", text: str = "review_text") -> DataFrame:
    """Word runs of ``lo`` to ``hi`` words of each text after stop-word removal, as one array ``ngrams``."""
    listed = df.select(*keys, tk.words(F.col(text), variant).alias("_words"))
    runs = [tk.ngrams(F.col("_words"), n) for n in range(lo, hi + 1)]
    return listed.select(*keys, (F.concat(*runs) if len(runs) > 1 else runs[0]).alias("ngrams"))


def phrase_counts(df: DataFrame, *keys: str, lo: int = 2, hi: int = 2, variant: str = "voice",
                  text: str = "review_text") -> DataFrame:
    """Counts of word runs of ``lo`` to ``hi`` words after stop-word removal."""
    exploded = phrase_arrays(df, *keys, lo=lo, hi=hi, variant=variant, text=text).select(*keys, F.explode("ngrams").alias("ngram"))
    return exploded.groupBy(*keys, "ngram").agg(F.count(F.lit(1)).alias("count"))


_FREQUENT_WORDS = 2_000  # words that a phrase expression lists


def _frequent_phrases(df: DataFrame, n: int, hi: int, variant: str, text: str = "review_text") -> DataFrame | None:
    """Exact counts of every run of 1 to ``hi`` words that may be among the ``n`` most frequent, and of few others.

    A run occurs no more often than each of its words, so words below the count of the n-th word are in none of them.
    None if too many words reach that count, or there are fewer than ``n``.
    """
    counts = word_counts(df, variant=variant, text=text).orderBy(*_by_count("term"))
    top = counts.limit(_FREQUENT_WORDS + 1).collect()
    if len(top) < n:
        return None
    kept = [r["term"] for r in top if r["count"] >= top[n - 1]["count"]]
    if len(kept) > _FREQUENT_WORDS:
        return None
    # other words become null, and so does every run that holds one
    listed = df.select(tk.words(F.col(text), variant).alias("_all")).select(
        F.transform("_all", lambda w: F.when(w.isin(*kept), w)).alias("_words"))
    runs = [F.col("_words")]
    for shift in range(2, hi + 1):
        rest = F.slice("_words", F.lit(shift), F.greatest(F.size("_words"), F.lit(0)))
        runs.append(F.zip_with(runs[-1], rest, lambda a, b: F.concat(a, F.lit(" "), b)))
    each = listed.select(F.explode(F.filter(F.concat(*runs), lambda r: r.isNotNull())).alias("ngram"))
    return each.groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))


def top_phrases(df: DataFrame, n: int = 20, lo: int = 2, hi: int = 2, variant: str = "voice",
                capacity: int | None = None) -> DataFrame:
    """Most frequent word runs. Where single words are among them, only runs of frequent words are counted. With a ``capacity`` only those that summaries of that size show as candidates are shuffled
    (see ``frequent``), which pays where most runs occur once or twice in a large table."""
    if capacity is not None:
        return frequent.top(phrase_arrays(df, lo=lo, hi=hi, variant=variant), "ngrams", n, capacity, "ngram")
    counts = _frequent_phrases(df, n, hi, variant) if lo == 1 and hi > 1 else None
    if counts is None:
        counts = phrase_counts(df, lo=lo, hi=hi, variant=variant)
    return counts.orderBy(*_by_count("ngram")).limit(n)


def top_phrases_by(df: DataFrame, keys: list[str], n: int, variant: str = "voice", max_texts: int | None = None,
                   lo: int = 2, hi: int = 2) -> DataFrame:
    """Top phrases of every group; groups are ranked after counting, so a hot group is already small."""
    capped = cap_texts(df, keys, max_texts)
    return scaling.first_per_group(phrase_counts(capped, *keys, lo=lo, hi=hi, variant=variant), keys,
                                   _by_count("ngram"), n)


def voice(df: DataFrame, n: int = 20, sentiment: str = "sentiment", aspect: str | None = None,
          max_texts: int | None = None) -> DataFrame:
    """Top bigrams of positive and of negative reviews, optionally of one aspect."""
    rows = df.filter(F.col(sentiment).isin("Positive", "Negative")).withColumn("polarity", F.col(sentiment))
    if aspect is not None:
        rows = rows.filter(F.col("aspect") == aspect)
    return top_phrases_by(rows, ["polarity"], n, max_texts=max_texts)


def cloud(df: DataFrame, polarity: str, n: int = 150, sentiment: str = "sentiment",
          max_texts: int | None = None) -> DataFrame:
    """Word frequencies behind a word cloud; any polarity but ``positive`` means negative."""
    label = "Positive" if polarity == "positive" else "Negative"
    rows = cap_texts(df.filter(F.col(sentiment) == label), [sentiment], max_texts)
    return top_terms(rows, n, variant="voice")

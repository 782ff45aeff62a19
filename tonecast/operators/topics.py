"""Topic words per polarity (latent Dirichlet allocation)."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.functions import tokens as tk
from tonecast.operators import scaling
from tonecast.session import materialize

_SCHEMA = "topic int, rank int, term string, weight double"


def topics(df: DataFrame, k: int = 6, n_words: int = 12, max_features: int = 4000, min_df: int = 5,
           max_iter: int = 15, seed: int = 42) -> DataFrame:
    """Most probable words of every topic. Empty for fewer than ``2k`` texts or without a vocabulary."""
    spark = df.sparkSession
    words = df.select(tk.words(F.col("review_text")).alias("words"))
    if words.limit(2 * k).count() < 2 * k:
        return spark.createDataFrame([], _SCHEMA)
    # minDF fails when no word qualifies, so that is tested on the counts first
    document_frequency = words.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count()
    if document_frequency.filter(F.col("count") >= min_df).isEmpty():
        return spark.createDataFrame([], _SCHEMA)
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=max_features, minDF=min_df).fit(words)
    vectors = counter.transform(words).select("features")
    # every iteration passes over them
    vectors = materialize(scaling.compact(vectors, vectors.count(), 200), "topics")
    model = LDA(k=k, maxIter=max_iter, optimizer="online", subsamplingRate=1.0, seed=seed).fit(vectors)
    described = model.describeTopics(n_words).collect()  # k rows
    vocabulary = counter.vocabulary
    rows = [(r["topic"], i + 1, vocabulary[t], float(w)) for r in described
            for i, (t, w) in enumerate(zip(r["termIndices"], r["termWeights"]))]
    return spark.createDataFrame(rows, _SCHEMA)


def topics_by_polarity(df: DataFrame, sentiment: str = "sentiment", **settings) -> DataFrame:
    """Topics of positive and of negative reviews."""
    parts = [topics(df.filter(F.col(sentiment) == label), **settings).select(F.lit(label).alias("polarity"), "*")
             for label in ("Positive", "Negative")]
    return parts[0].unionByName(parts[1])

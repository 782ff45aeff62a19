"""Frequent items, exact quantiles and column profiles against plain counting."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonecast.operators import features, frequent, phrases, profile, quantiles


def lists(seed, n, words):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1) ** 1.2
    return [[f"w{i}" for i in rng.choice(words, int(rng.integers(0, 12)), p=share / share.sum())] + [f"rare{k}"] for k in range(n)]


@pytest.mark.parametrize("capacity", [5, 60, 100_000])
def test_top_items(spark, capacity):
    rows = lists(1, 3000, 400)
    df = spark.createDataFrame([(r,) for r in rows] + [(None,), ([],), ([None, "w0"],)], "items array<string>").repartition(5)
    want = sorted(Counter([x for r in rows for x in r] + ["w0"]).items(), key=lambda x: (-x[1], x[0]))
    for n in (1, 20):
        assert [tuple(r) for r in frequent.top(df, "items", n, capacity).collect()] == want[:n]
    found = frequent.candidates(df, "items", 20, capacity)
    if capacity == 60:  # far fewer than the distinct items, and none of the first 20 is missing
        names = {r["item"] for r in found[0].collect()}
        assert {x for x, _ in want[:20]} <= names and len(names) < 200 < len(want)
        assert all(c < found[1] for x, c in want if x not in names)
    if capacity == 5:
        assert found is None


def test_summaries_bound_every_count(spark):
    rows = lists(2, 2000, 300)
    df = spark.createDataFrame([(r,) for r in rows], "items array<string>").repartition(7)
    told = frequent.summaries(df, "items", 50).collect()
    low, short, true = Counter(), sum(r["low"] for r in told if r["item"] is None), Counter(x for r in rows for x in r)
    for r in told:
        if r["item"] is not None:
            low[r["item"]] += r["low"]
    assert len(low) <= 7 * 50 and all(low[x] <= c <= low[x] + short for x, c in true.items())


def test_top_items_of_nothing(spark):
    df = spark.createDataFrame([], "items array<string>")
    assert frequent.top(df, "items", 3).count() == 0


def test_vocabulary_and_phrases_are_the_same(spark):
    texts = [" ".join(r) for r in lists(3, 800, 200)]
    df = spark.createDataFrame([(t,) for t in texts], "review_text string")
    whole = features.vocabulary(df, "review_text", 60)
    for capacity in (10, 300, 1_000_000):
        assert features.vocabulary(df, "review_text", 60, capacity=capacity).equals(whole)
    same = phrases.top_phrases(df, 10, 1, 2).collect()
    assert phrases.top_phrases(df, 10, 1, 2, capacity=200).collect() == same


@pytest.mark.parametrize("accuracy", [50, 2000])
def test_quantiles_equal_sorting(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(5)
    n = 4001
    data = pd.DataFrame({
        "even": rng.random(n), "heavy": np.exp(rng.normal(0, 30, n)), "few": rng.integers(1, 6, n).astype(float),
        "hot": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n)), "one": np.full(n, 3.5), "signed": -np.exp(rng.normal(0, 5, n)),
        "halves": np.where(np.arange(n) < n // 2, 1.0, 2.0)})
    df = spark.createDataFrame(data).repartition(6).withColumn("holes", F.when(F.col("even") < 0.3, F.col("heavy")))
    df = df.withColumn("none", F.lit(None).cast("double")).withColumn("whole", (F.col("even") * 1000).cast("int"))
    columns, probs = df.columns, [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact(df, columns, probs)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in columns]).first()
    for c in columns:
        for i, p in enumerate(probs):
            assert got[c, p] == (None if want[c] is None else pytest.approx(want[c][i], rel=1e-12))


def test_quantiles_of_little(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "v double")
    assert quantiles.exact(df, ["v"], [0.5, 0.25]) == {("v", 0.5): 1.5, ("v", 0.25): 1.25}
    assert quantiles.exact(df.limit(0), ["v"], [0.5]) == {("v", 0.5): None}


def test_profile_of_many_distinct_texts(spark):
    """A million rows of distinct long texts that share their heads, and ties."""
    n = 1_000_000
    df = spark.range(n).select(
        F.concat(F.lit("x" * 40), F.lpad(F.col("id").cast("string"), 7, "0")).alias("unique"),
        F.concat(F.lit("y" * 50), (F.col("id") % 3).cast("string")).alias("tied"), (F.col("id") % 10).alias("digit"),
        F.lit(None).cast("string").alias("none"))
    got = {r["column"]: r for r in profile.describe_all(df).collect()}
    assert set(got) == {"unique", "tied", "digit"}
    assert (got["unique"]["n_distinct"], got["unique"]["top"], got["unique"]["freq"]) == (n, "x" * 40 + "0000000", 1)
    assert (got["tied"]["n_distinct"], got["tied"]["top"], got["tied"]["freq"]) == (3, "y" * 50 + "0", 333_334)
    assert (got["digit"]["top"], got["digit"]["mean"], got["digit"]["q1"], got["digit"]["median"], got["digit"]["q3"]) == ("0", 4.5, 2.0, 4.5, 7.0)

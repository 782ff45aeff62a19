"""Steps that grew faster than they had to: what they read, sort, send and give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonecast import taxonomy as tx
from tonecast.functions import expressions as ex
from tonecast.operators import oversampling, phrases, profile, scaling


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrases_of_rare_words_are_not_counted(spark):
    rng = np.random.default_rng(3)
    rows = [(" ".join(["alpha bravo charlie"] * (k % 3) + [f"w{'abcdefghij'[d]}{'abcdefghij'[k % 10]}x" for d in rng.integers(0, 10, 12)]),)
            for k in range(200)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "review_text string")
    plain = {r["ngram"]: r["count"] for r in phrases.phrase_counts(df, lo=1, hi=3).collect()}
    want = sorted(plain.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r["ngram"], r["count"]) for r in phrases.top_phrases(df, 5, 1, 3).collect()] == want
    counted = {r["ngram"]: r["count"] for r in phrases._frequent_phrases(df, 5, 3, "voice").collect()}
    assert counted.items() <= plain.items() and len(counted) < len(plain) / 10
    assert phrases._frequent_phrases(df, 10_000, 3, "voice") is None
    assert phrases.top_phrases(df, 10_000, 1, 3).count() == len(plain)


def test_modes_are_hashed_not_sorted(spark, monkeypatch):
    plans, kept = [], profile.materialize
    monkeypatch.setattr(profile, "materialize", lambda df, name: plans.append(plan_of(df)) or kept(df, name))
    long = "x" * 40
    df = spark.createDataFrame([(long + "b", 1, None), (long + "a", 1, None), (None, 2, None)], "t string, n int, nothing string")
    got = {r["column"]: (r["n_distinct"], r["top"], r["freq"]) for r in profile._modes(df).collect()}
    assert got == {"t": (2, long + "a", 1), "n": (2, "1", 2)}
    assert plans and not any("SortAggregate" in p for p in plans)


def test_keyword_rules_read_arrow_batches(spark):
    texts = ["Top-up please", "top\nup", "topup", "real time", None, "", "nothing", "A CLEAN platform", "air con", "airécon", "aircon"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", ex.first_rule(F.col("t"), tx.ASPECT_RULES, "-").alias("a"))
    assert "ArrowEvalPython" in plan_of(out)
    java = F.lit("-")
    for name, pattern in reversed(tx.ASPECT_RULES):
        java = F.when(F.lower(F.coalesce("t", F.lit(""))).rlike(pattern), name).otherwise(java)
    assert sorted(out.collect()) == sorted(df.select("i", java).collect())
    other = df.select(ex.first_rule(F.col("t"), [("x", r"(?:top)\Wup")], "-"))
    assert "ArrowEvalPython" not in plan_of(other) and other.first()[0] == "x"


@pytest.mark.parametrize("rows", [1, 5_000, 5_001, 100_000, 1_400_001, 10_000_000, 300_000_000])
def test_each_step_of_a_fit_sends_one_sum(spark, rows):
    """The steps of treeAggregate, without its work."""
    df, depth = scaling.for_steps(spark.range(10).repartition(1), rows)
    n = df.rdd.getNumPartitions()
    scale = max(math.ceil(n ** (1 / depth)), 2)
    while n > scale + math.ceil(n / scale):
        n //= scale
    assert n == 1


def test_vectors_are_made_once(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    kept, names = oversampling.materialize, []
    monkeypatch.setattr(oversampling, "materialize", lambda df, name: names.append(name) or kept(df, name))
    rows = [(f"{k}", "a" if k < 6 else "b", Vectors.sparse(4, [k % 4], [1.0])) for k in range(8)] + [("x", None, Vectors.sparse(4, [0], [1.0]))]
    out = oversampling.interpolate_minority(spark.createDataFrame(rows, ["review_id", "sentiment", "features"]))
    assert names == ["vectors"]
    assert {r["sentiment"]: r["count"] for r in out.groupBy("sentiment").count().collect()} == {"a": 6, "b": 6}

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonecast.functions import expressions as ex
from tonecast.operators import evaluation, retrieval, scaling, splits
from tonecast.sources import caches


@pytest.fixture(scope="module")
def hot(spark):
    """A third of 9,000 rows share one key; a few keys are null."""
    return spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_equals_the_plain_join(spark, hot, how):
    right = spark.range(0, 500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v"))
    right = right.unionByName(spark.createDataFrame([("hot", -1), ("hot", -2)], "key string, v long"))
    got = scaling.join_hot_keys(hot, right, "key", how)
    want = hot.join(right, "key", how)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(map(tuple, want.select(columns).collect()), key=key)


def test_hot_join_spreads_the_hot_key(spark, hot):
    right = spark.createDataFrame([("hot", 1)], "key string, v int")
    joined = scaling.join_hot_keys(hot, right, "key", "inner")
    plan = joined._jdf.queryExecution().toString()
    assert "_sub" in plan
    assert joined.count() == 3000


def test_hot_join_rejects_other_joins(spark, hot):
    with pytest.raises(ValueError):
        scaling.join_hot_keys(hot, hot, "key", "full")


def test_first_per_group_with_large_k(hot):
    small = scaling.first_per_group(hot, ["key"], [F.asc("id")], 2000)
    pdf = hot.toPandas()
    want = pdf.sort_values("id").groupby("key", dropna=False).head(2000)
    assert small.count() == len(want)
    assert sorted(r["id"] for r in small.filter("key = 'hot'").collect()) == sorted(want[want.key == "hot"]["id"])
    assert small.filter("key = 'hot'").agg(F.max("rank")).first()[0] == 2000


def test_first_per_group_is_pruned_before_the_shuffle(hot):
    plan = scaling.first_per_group(hot, ["key"], [F.asc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_large_hash_sample_is_exact(spark, monkeypatch):
    df = spark.range(5000)
    hashed = ex.seeded_hash(42, F.col("id"))
    want = {r["id"] for r in df.orderBy(hashed, "id").limit(1234).collect()}
    monkeypatch.setattr(scaling, "_SMALL_LIMIT", 10)
    got = [r["id"] for r in scaling.hash_sample(df, 1234, hashed, F.col("id")).collect()]
    assert len(got) == 1234 and set(got) == want
    assert scaling.hash_sample(df, 6000, hashed, F.col("id")).count() == 5000


def test_distributed_rank_is_a_permutation(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") % 4 == 0, "a").otherwise("b"))
    ranked = scaling.distributed_rank(df, "g", ex.seeded_hash(1, F.col("id")), F.col("id"))
    for g, n in (("a", 500), ("b", 1500)):
        assert sorted(r["rank"] for r in ranked.filter(F.col("g") == g).collect()) == list(range(1, n + 1))


def test_spread_small_input(spark):
    one = spark.range(100).coalesce(1)
    assert scaling.spread_small_input(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 64)
    assert scaling.spread_small_input(many, "id") is many


# ---- splits ----------------------------------------------------------------------------

def test_hash_and_stratified_splits(spark):
    df = spark.range(6000).select((F.col("id") % 2500).cast("string").alias("text_id"),
                                  F.when(F.col("id") % 2500 % 10 == 0, "Negative").otherwise("Positive").alias("sentiment"))
    split = splits.with_split(df)
    splits.verify_no_leakage(split)
    shares = {r["split"]: r["count"] / 6000 for r in split.groupBy("split").count().collect()}
    assert shares["test"] == pytest.approx(0.2, abs=0.03) and shares["train"] == pytest.approx(0.6, abs=0.03)

    folds = splits.stratified_folds(df)
    assert folds.count() == 2500
    per = folds.groupBy("label", "fold").count().toPandas()
    assert per.groupby("label")["count"].agg(lambda c: c.max() - c.min()).max() <= 1
    attached = splits.attach_split(df, folds)
    assert attached.count() == 6000 and attached.filter("split is null").count() == 0
    splits.verify_no_leakage(attached)


def test_leakage_is_reported(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "text_id string, split string")
    assert splits.leaking_groups(df).collect()[0]["text_id"] == "a"
    with pytest.raises(RuntimeError):
        splits.verify_no_leakage(df)
    with pytest.raises(ValueError):
        splits.require_two_classes(spark.createDataFrame([("Positive",)], "sentiment string"))


# ---- caches ----------------------------------------------------------------------------

def test_cache_scores_only_missing_texts_and_is_idempotent(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("2", "a", "x"), ("3", "b", "y"), ("4", "c", "z")],
                               "review_id string, text_id string, review_text string")
    cache = spark.createDataFrame([("a", "old"), ("q", "kept")], "text_id string, aspect_pred string")
    seen = []

    def scorer(rows):
        seen.append(sorted(r["text_id"] for r in rows.collect()))
        return rows.withColumn("aspect_pred", F.concat(F.lit("new "), "review_text"))

    rows, grown = caches.complete_cache(df, cache, scorer)
    assert seen == [["b", "c"]]
    assert {r["review_id"]: r["aspect_pred"] for r in rows.collect()} == {"1": "old", "2": "old", "3": "new y", "4": "new z"}
    again = caches.complete_cache(df, grown, scorer)[1]
    assert seen[1] == [] and sorted(again.collect()) == sorted(grown.collect())


def test_documents_are_seeded_once(spark):
    old = spark.createDataFrame([("1", "old")], "id string, document string")
    new = spark.createDataFrame([("1", "new"), ("2", "new")], "id string, document string")
    assert caches.merge_documents(old, new).collect() == old.collect()
    assert sorted(map(tuple, caches.merge_documents(old, new, force=True).collect())) == [("1", "new"), ("2", "new")]
    assert caches.merge_documents(old.limit(0), new).count() == 2


# ---- nearest neighbours ----------------------------------------------------------------

def brute_force(q, d, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(d).T, 12)
    return {(i, int(j), r + 1) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(d)), -scores[i]))[:k])}


@pytest.mark.parametrize("query_bytes", [retrieval.QUERY_BYTES, 0])
def test_nearest_equals_brute_force(spark, query_bytes, monkeypatch):
    monkeypatch.setattr(retrieval, "_QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "_DOCUMENT_BLOCK", 50)
    rng = np.random.default_rng(0)
    q, d = rng.normal(size=(20, 8)), rng.normal(size=(300, 8))
    d[100:110] = d[0]  # equal documents: the lowest ids win

    def frame(m):
        return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(m)), "embedding": list(m)}), "id long, embedding array<double>")

    got = retrieval.nearest(frame(q), frame(d).repartition(5), 4, query_bytes=query_bytes)
    assert {(r["query_id"], r["document_id"], r["rank"]) for r in got.collect()} == brute_force(q, d, 4)


def test_nearest_is_capped_by_the_collection(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    assert retrieval.nearest(df, df, 8).count() == 4
    assert retrieval.nearest(df, df, 8, include_self=False).count() == 2


def test_conversation_tail(spark):
    df = spark.createDataFrame([(1, t, "user", "x") for t in range(9)] + [(2, 0, "user", "y")],
                               "conv_id long, turn long, role string, text string")
    assert [(r["conv_id"], r["turn"]) for r in retrieval.conversation_tail(df).orderBy("conv_id", "turn").collect()] == [
        (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 0)]


def test_first_in_order_is_the_same_in_ranges(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), "id").repartition(7)
    want = sorted(scaling.first_in_order(df, 1234, ["k"]).collect())
    monkeypatch.setattr(scaling, "_SMALL_LIMIT", 10)
    assert sorted(scaling.first_in_order(df, 1234, ["k"]).collect()) == want
    assert scaling.first_in_order(df, 9000, ["k"]).count() == 5000


def test_rank_with_null_groups_and_many_digits(spark, monkeypatch):
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), "id")
    monkeypatch.setattr(scaling, "_BUCKET_ROWS", 5)
    rows = scaling.distributed_rank(df, "g", F.md5(F.col("id").cast("string")), F.col("id")).collect()
    assert len(rows) == 600
    for g in (None, 1, 2):
        assert sorted(r["rank"] for r in rows if r["g"] == g) == list(range(1, 201))


# ---- folds by label mix ----------------------------------------------------------------

def _greedy(groups, folds):
    """One group after another, the most uneven first, to the fold of least deviation."""
    labels = len(groups[0])
    totals = [max(1, sum(g[j] for g in groups)) for j in range(labels)]
    held = [[0] * labels for _ in range(folds)]
    for g in sorted(groups, key=lambda g: (-np.var(g), g)):
        def cost(k):
            return np.mean([np.std([(held[i][j] + (g[j] if i == k else 0)) / totals[j] for i in range(folds)]) for j in range(labels)])
        k = min(range(folds), key=cost)
        held[k] = [h + x for h, x in zip(held[k], g)]
    return held, totals


def _deviation(held, totals):
    return np.mean([np.std([h[j] / totals[j] for h in held]) for j in range(len(totals))])


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 200), (3, 11)])
def test_folds_balance_the_label_mix(spark, seed, n):
    rng = np.random.default_rng(seed)
    groups = [tuple(int(x) for x in rng.poisson([3, 0.7, 0.2]) * (rng.random(3) < 0.6)) for _ in range(n)]
    groups[0] = (60, 5, 9)  # a text that occurs very often
    rows = [(f"g{i}", label) for i, g in enumerate(groups) for label, c in zip("ABC", g) for _ in range(c)]
    rows += [("unlabelled", None)] * 3 + [("other", "Z")] + [(None, "A")]
    df = spark.createDataFrame(rows, "text_id string, sentiment string")
    got = splits.mixed_folds(df, ["A", "B", "C"]).collect()
    folds = {r["text_id"]: r["fold"] for r in got}
    assert len(got) == len({k for k, _ in rows}) and set(folds.values()) <= set(range(5))
    held, totals = [[0, 0, 0] for _ in range(5)], [0, 0, 0]
    for key, label in rows:
        if label in ("A", "B", "C"):
            held[folds[key]]["ABC".index(label)] += 1
            totals["ABC".index(label)] += 1
    own = [g for g in groups if sum(g)] + [(1, 0, 0)]
    assert _deviation(held, [max(1, t) for t in totals]) <= _deviation(*_greedy(own, 5)) * 1.05 + 0.01
    assert {r["text_id"]: r["split"] for r in got} == {k: ["test", "val", "train", "train", "train"][f] for k, f in folds.items()}


def test_folds_of_nothing(spark):
    assert splits.deal_profiles([], 5) == []
    assert splits.mixed_folds(spark.createDataFrame([], "text_id string, sentiment string"), ["A"]).count() == 0


def test_confusion_of_many_labels(spark):
    """Ten thousand rows of a thousand labels: every cell of the matrix once, in blocks."""
    rng = np.random.default_rng(1)
    rows = [(f"l{a}", f"l{b}") for a, b in zip(rng.integers(0, 1000, 10_000), rng.integers(500, 1300, 10_000))] + [(None, "l1"), ("l2", None)]
    df = spark.createDataFrame(rows, "aspect string, aspect_pred string")
    table = evaluation.union_confusion(df)
    labels = {x for a, b in rows if a and b for x in (a, b)}
    told = table.agg(F.count("*"), F.sum("rows"), F.count_distinct("true_label", "pred_label")).first()
    assert tuple(told) == (len(labels) ** 2, 10_000, len(labels) ** 2)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan
    counts = {(r["true_label"], r["pred_label"]): r["rows"] for r in table.filter("rows > 0").collect()}
    assert counts == {k: n for k, n in __import__("collections").Counter((a, b) for a, b in rows if a and b).items()}

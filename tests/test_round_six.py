"""Steps of the features, the fit and the neighbours that took too long on large tables."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonecast import taxonomy as tx
from tonecast.operators import classifier, cleaning, features, sparse_neighbours


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def terms_of(text: str | None) -> list[str]:
    words = re.findall(r"\w{2,}", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(11)
    drawn = [" ".join(f"w{d}" for d in rng.zipf(1.4, rng.integers(0, 60)) if d < 400) for _ in range(150)]
    rows = [*drawn, None, "", "a", "Éclair ÉCLAIR x9 x9 x9 x9", "日本語 日本語 tick_tock", "one-two one", drawn[0]]
    return spark.createDataFrame(list(enumerate(rows)), "review_id int, review_text string"), rows


def test_terms_are_counted_in_batches(spark, texts, monkeypatch):
    df, rows = texts
    uses, seen = Counter(t for r in rows for t in terms_of(r)), Counter(t for r in rows for t in set(terms_of(r)))
    for size in (features._WORDS, 40):
        monkeypatch.setattr(features, "_WORDS", size)
        stats = features.term_statistics(df, "review_text")
        assert {r["term"]: (r["cf"], r["df"]) for r in stats.collect()} == {t: (uses[t], seen[t]) for t in uses}
    # a use of a term is no row of the plan
    assert "Generate" not in plan_of(stats)


@pytest.mark.parametrize("sublinear", [True, False])
def test_weights_of_whole_batches(spark, texts, sublinear, monkeypatch):
    df, rows = texts
    model = features.TfIdf.fit(df, "review_text", max_features=200, min_df=2, sublinear=sublinear)
    idf, wanted = dict(zip(model.terms, model.idf, strict=True)), {}
    for k, text in enumerate(rows):
        n = Counter(t for t in terms_of(text) if t in idf)
        x = {t: (1 + np.log(c) if sublinear else c) * idf[t] for t, c in n.items()}
        length = np.sqrt(sum(v * v for v in x.values()))
        wanted |= {(k, t): v / length for t, v in x.items()}
    for size in (features._WORDS, 40):
        monkeypatch.setattr(features, "_WORDS", size)
        table = features.weights_table(model, df, "review_text", "review_id")
        got = {(r["review_id"], r["term"]): r["weight"] for r in table.collect()}
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-12 for k in got)
        plan = plan_of(table)
        assert "Generate" not in plan and "Join" not in plan
        vectors = {r["review_id"]: r["features"] for r in model.transform(df, "review_text").collect()}
        assert all(v.size == len(idf) and list(v.indices) == sorted(v.indices) for v in vectors.values())
        assert sum(len(v.indices) for v in vectors.values()) == len(wanted)


def test_both_forms_of_the_rules_agree(spark):
    rows = ["Top-up please", "top\nup", None, "", "nothing", "A CLEAN platform", "airécon", "aircon", "Real time"]
    df = spark.createDataFrame([(t,) for t in rows], "review_text string")
    plain, batched = (cleaning.with_rule_aspect(df, batched=b) for b in (False, True))
    assert "Python" not in plan_of(plain) and "Arrow" not in plan_of(plain) and "ArrowEvalPython" in plan_of(batched)
    assert [r[1] for r in plain.collect()] == [r[1] for r in batched.collect()]
    assert plain.filter(F.col("aspect_pred") == tx.RULE_FALLBACK).count() == 4


def test_background_is_added_up_in_tasks(texts):
    df, rows = texts
    model = features.TfIdf.fit(df, "review_text", min_df=2)
    sums = model.sums(df, "review_text")
    assert "Generate" not in plan_of(sums)
    got = {r["index"]: r["s"] for r in sums.collect()}
    total = sum(r["features"].toArray() for r in model.transform(df, "review_text").collect())
    assert got.pop(-1) == len(rows)
    assert got.keys() == set(np.flatnonzero(total).tolist()) and all(abs(got[k] - total[k]) < 1e-9 for k in got)


def test_training_rows_are_chosen_once(spark, monkeypatch):
    kept, materialize = [], classifier.materialize
    monkeypatch.setattr(classifier, "materialize", lambda df, name: kept.append(name) or materialize(df, name))
    rows = [("fare", w, s) for w, s in (("cheap good", "Positive"), ("late bad", "Negative"))] * 3
    model = classifier.SentimentModel.fit(spark.createDataFrame(rows, "aspect string, review_text string, sentiment string"))
    assert kept[0] == "train" and model.classes == ["Negative", "Positive"]


@pytest.mark.parametrize("pairs,columns", [(4_000_000, 512), (50, 3)])
def test_products_of_common_and_rare_terms(pairs, columns, monkeypatch):
    monkeypatch.setattr(sparse_neighbours, "_PAIRS", pairs)
    monkeypatch.setattr(sparse_neighbours, "_COLUMNS", columns)
    rng = np.random.default_rng(5)

    def drawn(n):
        dense = np.where(rng.random((n, 300)) < 1 / np.arange(1, 301), rng.random((n, 300)), 0)
        dense[n // 2] = 0
        sizes, (_, index) = (dense > 0).sum(axis=1), np.nonzero(dense)
        return dense, (np.concatenate(([0], np.cumsum(sizes))), index.astype(np.int32), dense[dense > 0])
    (a, q), (b, d) = drawn(40), drawn(70)
    assert np.abs(sparse_neighbours.products(q, d) - a @ b.T).max() < 1e-12
    none = (np.zeros(3, np.int64), np.zeros(0, np.int32), np.zeros(0))
    assert not sparse_neighbours.products(none, d).any() and sparse_neighbours.products(q, none).shape == (40, 2)
    # a column of a term that most rows share is not paired entry by entry
    paired, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: paired.append(len(x)) or bincount(x, *a, **k))
    sparse_neighbours.products(q, d)
    assert sum(n for n in paired) < ((a > 0).sum(axis=0) * (b > 0).sum(axis=0)).sum()


def test_best_columns():
    scores = np.round(np.random.default_rng(6).random((50, 30)), 1)
    scores[3, 1:] = -np.inf
    scores[4] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")
    for k in (1, 3, 16, 20, 30, 40):
        best, found = sparse_neighbours.best_columns(scores, k)
        real = found > -np.inf
        assert (found == np.take_along_axis(scores, order[:, :k], axis=1)).all() and (best[real] == order[:, :k][real]).all()

"""Steps that must grow with their input alone."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tonecast import taxonomy as tx
from tonecast.functions import expressions as ex
from tonecast.operators import cleaning, frequent, retrieval


def test_rules_read_the_text_once(spark):
    """The text is lowered once for all keywords, and not at all where nothing asks for the name."""
    df = cleaning.with_rule_aspect(spark.createDataFrame([("Dirty seat",), ("train fare",), (None,)], "review_text string"), "aspect")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 1
    assert "lower(" not in df.groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    filtered = df.select("aspect", F.lit(1)).filter(F.col("aspect") == tx.RULE_FALLBACK)
    assert filtered._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2
    assert [r["aspect"] for r in df.collect()] == ["Crowding & Comfort", "Fare & Payment System", tx.RULE_FALLBACK]
    assert df.select(ex.first_rule(F.col("review_text"), [("a", "seat|x")], "-").alias("n")).collect()[0]["n"] == "a"


def test_neighbours_are_screened(spark, monkeypatch):
    """Few pairs are scored in double precision and sorted; equal vectors, ties, broken vectors and results stay."""
    rng = np.random.default_rng(1)
    m = rng.normal(size=(3_000, 16))
    m[7], m[9], m[11, 0], m[12] = m[5], m[5], np.nan, 0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, embedding array<double>").coalesce(1)
    s = np.round(retrieval.unit(m) @ retrieval.unit(m).T, 12)
    np.fill_diagonal(s, -np.inf)
    s[np.isnan(s)] = -np.inf
    wanted = {(i, int(j)) for i in range(len(m)) if i != 11 for j in np.lexsort((np.arange(len(m)), -s[i]))[:4]}
    for size in (retrieval.QUERY_BYTES, 0):
        found = retrieval.nearest(df, df, 4, include_self=False, query_bytes=size)
        assert {(r["query_id"], r["document_id"]) for r in found.collect()} == wanted
        # comparing all pairs happens once, however often the result is read
        assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    sorted_rows = []
    frame = retrieval.pd.DataFrame.sort_values
    monkeypatch.setattr(retrieval.pd.DataFrame, "sort_values", lambda self, *a, **kw: sorted_rows.append(len(self)) or frame(self, *a, **kw))
    own = retrieval._vectors(np.arange(len(m)), list(m))
    retrieval.best_pairs(4, True)(own, own)
    assert sum(sorted_rows) < 0.05 * len(m) ** 2


def test_summaries_stay_in_arrow():
    """Sums and cuts of summaries handle whole arrays and lose nothing they do not tell."""
    rng, held, counts, short = np.random.default_rng(2), pa.array([], pa.string()), np.zeros(0, np.int64), 0
    drawn = [rng.zipf(1.5, 500) for _ in range(6)]
    for part in drawn:
        coded = pa.array([str(x) for x in part]).dictionary_encode()
        held, counts = frequent.added(held, counts, coded.dictionary, np.bincount(coded.indices.to_numpy()))
        held, counts, fell = frequent.trimmed(held, counts, 20)
        short += fell
        assert isinstance(held, pa.Array) and len(held) <= 20 and len(set(held.to_pylist())) == len(held)
    names, true = np.unique(np.concatenate(drawn).astype(str), return_counts=True)
    low = dict(zip(held.to_pylist(), counts.tolist(), strict=True))
    assert short > 0 and all(low.get(i, 0) <= n <= low.get(i, 0) + short for i, n in zip(names, true.tolist(), strict=True))

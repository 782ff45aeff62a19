"""The vector index against brute force: equal rows, spared pairs, recall of the first probes."""

import numpy as np
import pandas as pd
import pytest

from tests.test_scaling import brute_force
from tonecast.operators import vector_index
from tonecast.operators.vector_index import VectorIndex


def frame(spark, m, first=0):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(first, first + len(m)), "embedding": list(m)}), "id long, embedding array<double>")


def tight(seed, groups=40, each=50, dim=24):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(groups, 1, dim)) * 3 + rng.normal(size=(groups, each, dim)) * 0.3).reshape(-1, dim)


@pytest.mark.parametrize("scan_share", [0.0, 2.0])
def test_equals_brute_force(spark, monkeypatch, scan_share):
    """Whatever the directions spare; blocks and query blocks are small, ties and zero vectors are among the rows."""
    monkeypatch.setattr(vector_index, "SCAN_SHARE", scan_share)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 37)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 5)
    rng = np.random.default_rng(1)
    for d in (rng.normal(size=(300, 8)), tight(2, 10, 30, 8)):
        d[100:110] = d[0]
        d[20] = 0
        index = VectorIndex.build(frame(spark, d).repartition(4), lists=12)
        assert index.rows.count() == len(d)
        q = np.concatenate((d[:15] + 0.01, rng.normal(size=(10, 8))))
        got = index.search(frame(spark, q), 4, first_rows=20).collect()
        assert {(r["query_id"], r["document_id"], r["rank"]) for r in got} == brute_force(q, d, 4)


def test_bounds_hold_and_spare_tight_groups():
    d = tight(3)
    unit = vector_index.unit(d)
    directions = vector_index.fit_directions(d, 40)
    angle = np.arccos(np.clip(unit @ directions.T, -1, 1))
    own, ring = angle.argmin(axis=1), (angle.min(axis=1) / np.pi * vector_index.RINGS).astype(int)
    told = pd.DataFrame({"list": own, "ring": ring, "a": angle.min(axis=1)}).groupby(["list", "ring"]).a.agg(["min", "max", "size"]).reset_index()
    cells = vector_index.Cells(directions, *(told[c].to_numpy() for c in ("list", "ring", "min", "max", "size")))
    bounds, scores = cells.bounds(unit[::20]), unit[::20] @ unit.T
    for c in range(len(cells.list)):
        members = (own == cells.list[c]) & (ring == cells.ring[c])
        assert (scores[:, members].max(axis=1) <= bounds[:, c] + 1e-9).all()
    floor = np.sort(scores, axis=1)[:, -8]
    left = cells.rest(unit[::20], 100, floor)
    assert np.mean([cells.rows[c].sum() for c in left]) < 0.05 * len(d)


def test_recall_of_the_first_probes(spark):
    d = tight(4)
    index = VectorIndex.build(frame(spark, d), lists=40)
    q = frame(spark, d).filter("id % 50 = 0")
    got = {(r["query_id"], r["document_id"]) for r in index.search(q, 8, exact=False, first_rows=100).collect()}
    want = {(int(i * 50), j) for i, j, _ in brute_force(d[::50], d, 8)}
    assert len(got & want) >= 0.9 * len(want)


def test_edges(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (1, [1.0, 0.0])], "id long, embedding array<double>")
    assert VectorIndex.build(none).search(some).count() == 0
    index = VectorIndex.build(some)
    assert index.search(none).count() == 0
    got = sorted((r["query_id"], r["document_id"], round(r["score"], 6), r["rank"]) for r in index.search(some.limit(1), 8).collect())
    assert got == [(1, 1, 1.0, 1), (1, 1, 1.0, 2), (1, 3, 0.0, 3)]
    only_zero = VectorIndex.build(some.filter("id = 3"))
    assert [r["score"] for r in only_zero.search(some.limit(1)).collect()] == [0.0]

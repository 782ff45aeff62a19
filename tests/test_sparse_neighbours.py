"""Neighbours through inverted lists against brute force, and how many scores they take."""

import numpy as np
import pytest

from tonecast.operators import sparse_neighbours as sn


def rows_of(seed, n, terms, short=False):
    """Sparse unit rows of Zipf-like terms; some equal, some empty, some of one term."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, terms + 1) ** 1.1
    out = []
    for k in range(n):
        size = 0 if k % 37 == 5 else 1 if k % 41 == 7 else int(rng.integers(1, 4 if short else 15))
        index = np.sort(rng.choice(terms, size, replace=False, p=share / share.sum()))
        value = rng.random(size) + 0.05
        value /= np.linalg.norm(value) if size else 1
        out.append((k, index, value) if k % 29 or not out else (k, *out[-1][1:]))
    return out


def brute(rows, terms, k):
    m = np.zeros((len(rows), terms))
    for i, (_, index, value) in enumerate(rows):
        m[i, index] = value
    s = np.round(m @ m.T, 12)
    np.fill_diagonal(s, -np.inf)
    return {(i, int(j), r + 1): s[i, j] for i in range(len(rows)) for r, j in enumerate(np.lexsort((np.arange(len(rows)), -s[i]))[:k])}


def frame(spark, rows):
    return spark.createDataFrame([(k, [(int(a), float(b)) for a, b in zip(i, v)]) for k, i, v in rows],
                                 "id long, entries array<struct<index:int,value:double>>")


@pytest.mark.parametrize("seed, n, terms, short, block", [(1, 300, 400, False, 2048), (2, 250, 30, True, 16), (3, 120, 2000, True, 2048), (4, 7, 5, True, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, n, terms, short, block):
    monkeypatch.setattr(sn, "BLOCK_ROWS", block)
    rows = rows_of(seed, n, terms, short)
    got = sn.nearest(frame(spark, rows).repartition(3), 3, terms).collect()
    want = brute(rows, terms, 3)
    near = {(r["query_id"], r["rank"]): r["score"] for r in got}
    assert len(got) == len(want) and all(abs(near[q, rank] - s) < 1e-9 for (q, _, rank), s in want.items())
    # equal scores may differ in the last place, so ids are compared where the score is alone
    alone = {(q, d, r) for (q, d, r), s in want.items() if sum(abs(s - x) < 1e-9 for (p, _, _), x in want.items() if p == q) == 1 and r < 3}
    assert alone <= {(r["query_id"], r["document_id"], r["rank"]) for r in got}


def test_few_rows(spark):
    empty = frame(spark, [])
    assert sn.nearest(empty, 3, 5).count() == 0
    one = frame(spark, [(1, [0], [1.0])])
    assert sn.nearest(one, 3, 5).count() == 0
    two = frame(spark, [(1, [0], [1.0]), (2, [1], [1.0])])
    assert sorted((r["query_id"], r["document_id"], r["score"]) for r in sn.nearest(two, 3, 5).collect()) == [(1, 2, 0.0), (2, 1, 0.0)]


def test_needed_terms_lose_no_partner():
    """Whoever scores at least the floor shares a needed term."""
    rows, terms = rows_of(6, 200, 60), 60
    frequency, largest = np.zeros(terms, int), np.zeros(terms)
    for _, i, v in rows:
        frequency[i] += 1
        largest[i] = np.maximum(largest[i], v)
    for _, i, v in rows:
        for floor in (0.0, 0.2, 0.6, 0.95):
            needed = set(sn.needed_terms(i, v, frequency, largest, floor).tolist())
            for _, j, w in rows:
                score = sum(a * w[list(j).index(t)] for t, a in zip(i, v) if t in j)
                if score > 0 and score >= floor:
                    assert needed & set(j.tolist())


def test_far_fewer_scores_than_pairs(spark):
    rng, terms = np.random.default_rng(9), 4000
    rows = []
    for k in range(1500):  # groups of texts about one thing, common words in all
        own = 100 + (k // 5) * 12 + rng.choice(12, 8, replace=False)
        index = np.sort(np.concatenate((rng.choice(40, 6, replace=False), own)))
        value = np.where(index < 100, 0.1, 1.0) * (rng.random(len(index)) + 0.5)
        rows.append((k, index, value / np.linalg.norm(value)))
    df = frame(spark, rows)
    lists = sn.Lists(df.selectExpr("id", "transform(entries, x -> x.index) AS index", "transform(entries, x -> x.value) AS value"), terms)
    floors = sn.nearest(df, 3, terms).groupBy("query_id").agg({"score": "min"}).toDF("id", "floor")
    scored = lists.pairs(lists.asked(lambda i, v, n, w, f: sn.seed_terms(i, v, n, w))) + lists.pairs(lists.asked(sn.needed_terms, floors))
    assert scored < 0.1 * 1500 ** 2


def test_rows_of_many_common_terms_are_dealt_in_blocks(spark, monkeypatch):
    """Every list holds every row, so sending members to lists copies the table once a term; blocks copy it a few times."""
    monkeypatch.setattr(sn, "LEAST_BLOCK", 20)
    rng, n, terms = np.random.default_rng(4), 200, 300
    rows = []
    for k in range(n):
        index = np.sort(rng.choice(terms, 200, replace=False))
        value = rng.random(200)
        rows.append((k, index, value / np.linalg.norm(value)))
    dealt = []
    scored = sn.Lists._scored
    monkeypatch.setattr(sn.Lists, "_scored", lambda self, cells, k: dealt.append(cells.count()) or scored(self, cells, k))
    got = sn.nearest(frame(spark, rows), 3, terms).collect()
    assert sum(dealt) <= 2 * 6 * n
    want = brute(rows, terms, 3)
    near = {(r["query_id"], r["rank"]): r["score"] for r in got}
    assert len(got) == len(want) and all(abs(near[q, rank] - s) < 1e-9 for (q, _, rank), s in want.items())


def test_copies_of_a_row_are_one_neighbour(spark):
    rows = [(1, [0, 1], [0.6, 0.8]), (2, [0, 1], [0.6, 0.8]), (2, [0, 1], [0.6, 0.8]), (3, [0], [1.0]), (3, [0], [1.0])]
    got = sorted((r["rank"], r["document_id"]) for r in sn.nearest(frame(spark, rows), 2, 2).filter("query_id = 1").collect())
    assert got == [(1, 2), (2, 3)]

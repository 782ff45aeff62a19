"""Keys of several owners, whatever tasks and batches their rows fall into."""

from collections import defaultdict

import numpy as np
import pytest

from tonecast.llm.runs import of_several


@pytest.mark.parametrize("seed, keys, owners, batch", [(1, 3, 2, 5), (2, 40, 4, 3), (3, 1, 1, 4), (4, 2, 300, 7), (5, 300, 2, 1), (6, 5, 1, 2)])
def test_keys_of_several_owners(spark, seed, keys, owners, batch):
    rng = np.random.default_rng(seed)
    rows = [(int(k), int(o), i) for i, (k, o) in enumerate(zip(rng.integers(0, keys, 400), rng.integers(0, owners, 400)))]
    rows += [(1000 + k, 7, -k) for k in range(5)] + [(2000, 1, -9)] * 30
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        got = sorted(tuple(r) for r in of_several(spark.createDataFrame(rows, "key long, uid long, start int"), "key", "uid").collect())
    finally:
        spark.conf.set(name, before)
    own = defaultdict(set)
    for k, o, _ in rows:
        own[k].add(o)
    assert got == sorted(r for r in rows if len(own[r[0]]) > 1)


def test_no_rows(spark):
    assert of_several(spark.createDataFrame([], "key long, uid long"), "key", "uid").count() == 0

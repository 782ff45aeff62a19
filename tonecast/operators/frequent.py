"""Most frequent items of array columns, found by mergeable summaries and counted exactly.

Each task keeps a Misra-Gries summary: at most ``capacity`` items with counts that fall short of the true ones by no more
than a known amount, its shortfall. Summaries are added up; an item can be among the ``n`` most frequent only if its sum
plus all shortfalls reaches the n-th largest sum. Only these candidates are counted in a second pass, so rare items, which
are most of them, are never shuffled. Where the summaries were too small to tell, all items are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.session import materialize

CAPACITY = 200_000
_BROADCAST_ROWS = 500_000


def trimmed(items: pa.Array, counts: np.ndarray, capacity: int) -> tuple[pa.Array, np.ndarray, int]:
    """The summary cut to ``capacity`` items, and by how much every count fell."""
    if len(counts) <= capacity:
        return items, counts, 0
    least = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    kept = counts > least
    return items.filter(pa.array(kept)), counts[kept] - least, least


def added(items: pa.Array, counts: np.ndarray, more: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The sums of two summaries; both list every item once."""
    at = pc.index_in(items, value_set=more)
    new = at.is_null()
    n = n.copy()
    n[at.drop_null().to_numpy()] += counts[~new.to_numpy(zero_copy_only=False)]
    return pa.concat_arrays([more, items.filter(new)]), np.concatenate([n, counts[new.to_numpy(zero_copy_only=False)]])


def summaries(df: DataFrame, items: str, capacity: int = CAPACITY) -> DataFrame:
    """Per task the kept items with their counts (item, low) and one row of the shortfall (null item)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, short = pa.array([], pa.string()), np.zeros(0, np.int64), 0
        for batch in batches:
            coded = batch.column(0).flatten().drop_null().dictionary_encode()
            if not len(coded):
                continue
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
            # most items of a batch are cut at once, so they stay in Arrow
            held, counts = added(held, counts, coded.dictionary.cast(pa.string()), n)
            if len(held) > 2 * capacity:
                held, counts, fell = trimmed(held, counts, capacity)
                short += fell
        held, counts, fell = trimmed(held, counts, capacity)
        for k in range(0, len(held), 100_000):
            yield pa.RecordBatch.from_arrays([held.slice(k, 100_000), pa.array(counts[k:k + 100_000], pa.int64())], ["item", "low"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([short + fell], pa.int64())], ["item", "low"])
    return df.select(items).mapInArrow(run, "item string, low long")


def candidates(df: DataFrame, items: str, n: int, capacity: int = CAPACITY) -> tuple[DataFrame, int] | None:
    """Items that may be among the ``n`` most frequent, and a count that every other item stays below.

    None if the summaries cannot tell.
    """
    sums = materialize(summaries(df, items, capacity).groupBy("item").agg(F.sum("low").alias("low")), "summaries")
    short = sums.filter(F.col("item").isNull()).first()
    known = sums.filter(F.col("item").isNotNull())
    short = short["low"] if short else 0
    last = known.orderBy(F.desc("low"), "item").select("low").offset(n - 1).limit(1).first()
    if last is None:  # fewer items than asked for are known: that is all of them, if none was lost
        return (known.select("item"), 0) if short == 0 else None
    if short >= last["low"]:
        return None
    return known.filter(F.col("low") + short >= last["low"]).select("item"), last["low"]


def small(table: DataFrame) -> DataFrame:
    """The table, broadcast if it is short."""
    return F.broadcast(table) if table.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS else table


def counted(df: DataFrame, items: str, wanted: DataFrame | None = None, alias: str = "item") -> DataFrame:
    """(item, count) of all items, or of the ``wanted`` ones."""
    each = df.select(F.explode(items).alias("item")).filter(F.col("item").isNotNull())
    if wanted is not None:
        each = each.join(small(wanted), "item", "left_semi")
    return each.groupBy(F.col("item").alias(alias)).agg(F.count("*").alias("count"))


def top(df: DataFrame, items: str, n: int, capacity: int = CAPACITY, alias: str = "item") -> DataFrame:
    """The ``n`` most frequent items with exact counts, ties to the smaller item. ``df`` is read twice."""
    found = candidates(df, items, n, capacity)
    return counted(df, items, found[0] if found else None, alias).orderBy(F.desc("count"), F.asc(alias)).limit(n)

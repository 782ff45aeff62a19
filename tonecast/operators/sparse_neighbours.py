"""Exact nearest neighbours of sparse, non-negative unit vectors through inverted lists, without comparing all pairs.

The k-th score that a vector finds in the lists of a few of its rare, heavy terms is a floor. Terms are then left aside,
the most frequent first, as long as what they can add to any score (weight times the term's largest weight anywhere, or
the length of the part left aside) stays below the floor: a vector that shares none of the other terms cannot be among
the best k. The members of the lists of those other terms are compared in one sparse product per list, so every
neighbour is found and the lists of frequent terms are rarely read.

A member goes to every list with its whole vector. Where that sends more rows than dealing the table out in blocks and
comparing each block with each, as with long texts that share many terms, the blocks are compared instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.operators import scaling
from tonecast.session import materialize

BLOCK_ROWS = 2048  # members of a list that a task compares with as many others
BLOCK_ENTRIES, LEAST_BLOCK, LEAST_BLOCKS = 3_000_000, 256, 6  # when the table itself is cut: entries of a block, its least rows, and blocks of larger tables
SEED_TERMS, SEED_ROWS = 4, 256  # terms of a vector that give its floor, and the longest list they may have
# share of all pairs that have a term in common from which it is a column of a matrix, columns and pairs handled at once,
# and the most places picked one by one
_COMMON, _COLUMNS, _PAIRS, _PICKED = 0.005, 512, 4_000_000, 16
_SLICE = 256
_SLACK = 1e-9
_DIGITS = 12


def products(q: tuple, d: tuple) -> np.ndarray:
    """(query, document) scores of sparse rows given as (bounds, indices, values).

    Terms that many rows share are multiplied as a matrix, the entries of the others are paired.
    """
    (q_at, q_index, q_value), (d_at, d_index, d_value) = q, d
    n, m = len(q_at) - 1, len(d_at) - 1
    out = np.zeros((n, m))
    used, q_term = np.unique(q_index, return_inverse=True)
    if not len(used) or not len(d_index):
        return out
    place = np.full(max(int(used[-1]), int(d_index.max())) + 1, -1)
    place[used] = np.arange(len(used))
    d_term, d_row, q_row = place[d_index], np.repeat(np.arange(m), np.diff(d_at)), np.repeat(np.arange(n), np.diff(q_at))
    known = d_term >= 0
    d_term, d_row, d_value = d_term[known], d_row[known], d_value[known]
    many, held = np.bincount(q_term, minlength=len(used)), np.bincount(d_term, minlength=len(used))
    common = many.astype(np.float64) * held > _COMMON * n * m
    terms = np.flatnonzero(common)
    column = np.cumsum(common) - 1
    q_common, d_common = common[q_term], common[d_term]
    for start in range(0, len(terms), _COLUMNS):
        sides = []
        for rows, row, term, value, mine in ((n, q_row, q_term, q_value, q_common), (m, d_row, d_term, d_value, d_common)):
            own = np.flatnonzero(mine)
            at = column[term[own]] - start
            within = (at >= 0) & (at < _COLUMNS)
            side = np.zeros((rows, min(_COLUMNS, len(terms) - start)))
            side[row[own[within]], at[within]] = value[own[within]]
            sides.append(side)
        out += sides[0] @ sides[1].T
    # the other terms: every entry of a document meets the queries that have its term
    order = np.flatnonzero(~q_common)
    order = order[np.argsort(q_term[order], kind="stable")]
    many[common] = 0
    first = np.cumsum(many) - many
    rest = np.flatnonzero(~d_common)
    rest = rest[many[d_term[rest]] > 0]
    ends = np.cumsum(many[d_term[rest]])
    start = 0
    while start < len(rest):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, side="right")))
        part = rest[start:stop]
        times = many[d_term[part]]
        own = np.repeat(part, times)
        met = order[first[d_term[own]] + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)]
        out += np.bincount(q_row[met] * m + d_row[own], q_value[met] * d_value[own], n * m).reshape(n, m)
        start = stop
    return out


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``k`` largest scores of each row, largest first, ties to the first column."""
    if k > _PICKED or k >= scores.shape[1]:
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return best, np.take_along_axis(scores, best, axis=1)
    left, rows, best, found = scores.copy(), np.arange(len(scores)), [], []
    for _ in range(k):
        best.append(left.argmax(axis=1))
        found.append(left[rows, best[-1]])
        left[rows, best[-1]] = -np.inf
    return np.stack(best, axis=1), np.stack(found, axis=1)


def needed_terms(index: np.ndarray, value: np.ndarray, frequency: np.ndarray, largest: np.ndarray, floor: float) -> np.ndarray:
    """Terms of which a vector with a score of ``floor`` or more shares at least one."""
    order = np.lexsort((index, -frequency[index]))
    own = value[order]
    adds = np.minimum(np.cumsum(own * largest[index[order]]), np.sqrt(np.cumsum(own * own)))
    return index[order[int(np.searchsorted(adds, floor - _SLACK)):]]


def seed_terms(index: np.ndarray, value: np.ndarray, frequency: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """The heaviest terms with a short list of several members."""
    fit = (frequency[index] > 1) & (frequency[index] <= SEED_ROWS)
    order = np.argsort(-(value * largest[index])[fit], kind="stable")
    return index[fit][order[:SEED_TERMS]]


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal ``by``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in by])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            if held and tuple(keys[:, a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[:, a])
    if held:
        yield pa.Table.from_batches(held)


def _rows(t: pa.Table) -> tuple:
    index, value = (t.column(c).combine_chunks() for c in ("index", "value"))
    sizes = np.diff(index.offsets.to_numpy())
    return np.concatenate(([0], np.cumsum(sizes))), index.flatten().to_numpy(), value.flatten().to_numpy()


class Lists:
    """The inverted lists of a table (id, index, value) and what bounds need of each term."""

    def __init__(self, rows: DataFrame, terms: int):
        self.rows = rows
        self.id_type = rows.schema["id"].dataType.simpleString()
        told = rows.select("id", F.explode(F.arrays_zip("index", "value")).alias("e")).groupBy(F.col("e.index").alias("term")).agg(
            F.count("*").alias("n"), F.max("e.value").alias("w")).toPandas()  # the vocabulary is capped where it is fitted
        self.frequency, self.largest = np.zeros(terms, np.int64), np.zeros(terms)
        self.frequency[told["term"]], self.largest[told["term"]] = told["n"], told["w"]
        self.shared = rows.sparkSession.sparkContext.broadcast((self.frequency, self.largest))

    def asked(self, pick: Callable, floors: DataFrame | None = None) -> DataFrame:
        """(term, id): the lists of several members that ``pick`` names for each row."""
        shared = self.shared
        rows = self.rows if floors is None else self.rows.join(floors, "id", "left")
        rows = rows.withColumn("floor", F.coalesce("floor", F.lit(0.0)) if floors is not None else F.lit(0.0))

        def run(batches):
            frequency, largest = shared.value
            for pdf in batches:
                out = [pick(np.asarray(i), np.asarray(v), frequency, largest, f)
                       for i, v, f in zip(pdf["index"], pdf["value"], pdf["floor"], strict=True)]
                out = [t[frequency[t] > 1] for t in out]
                many = [len(t) for t in out]
                if sum(many):
                    yield pd.DataFrame({"term": np.concatenate(out).astype("int32"), "id": np.repeat(pdf["id"].to_numpy(), many)})
        return rows.mapInPandas(run, f"term int, id {self.id_type}")

    def pairs(self, asked: DataFrame) -> int:
        """Scores that comparing the asked lists computes."""
        sizes = asked.groupBy("term").count().toPandas()
        return int((sizes["count"] * self.frequency[sizes["term"]]).sum())

    def blocks(self, n: int) -> int:
        """Blocks that the table of ``n`` rows is cut into where each is compared with each."""
        by_size = BLOCK_ENTRIES * n // max(int(self.frequency.sum()), 1)
        return max(1, -(-n // max(1, min(by_size, max(LEAST_BLOCK, -(-n // LEAST_BLOCKS))))))

    def sent(self, asked: DataFrame) -> int:
        """Rows, each with its vector, that comparing the asked lists deals out."""
        of = self.frequency[asked.select("term").distinct().toPandas()["term"].to_numpy(dtype=np.int64)]  # at most the vocabulary
        parts = -(-of // BLOCK_ROWS)
        return int((of * np.where(parts > 1, 2 * parts, 1)).sum())

    def every(self, k: int, blocks: int) -> DataFrame:
        """The best ``k`` others of each row in each block of the table: (query_id, document_id, score)."""
        own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        yes, no, term = F.lit(True), F.lit(False), F.lit(0).alias("term")
        vector, rows = ["id", "index", "value"], self.rows.filter(F.col("id").isNotNull())
        if blocks == 1:
            dealt = rows.select(term, F.lit(0).alias("qb"), F.lit(0).alias("db"), *vector, yes.alias("asks"), yes.alias("holds"))
        else:
            asking = rows.select(term, own.alias("qb"), each.alias("db"), *vector, yes.alias("asks"), no.alias("holds"))
            holding = rows.select(term, each.alias("qb"), own.alias("db"), *vector, no.alias("asks"), yes.alias("holds"))
            dealt = asking.unionByName(holding)
        return self._scored(dealt, k)

    def compared(self, asked: DataFrame, k: int) -> DataFrame:
        """The best ``k`` others of each asking row in each asked list: (query_id, document_id, score)."""
        asked = asked.withColumn("asks", F.lit(True))
        sizes = asked.groupBy("term").agg(F.count("*").alias("q"))
        members = self.rows.select("id", F.explode("index").alias("term")).join(
            F.broadcast(sizes.select("term")), "term", "left_semi")  # at most the vocabulary
        frequency = self.frequency
        parts = -(-frequency // BLOCK_ROWS)
        long = [(int(t), int(parts[t])) for t in np.flatnonzero(parts > 1)]
        spark = self.rows.sparkSession
        cut = F.broadcast(spark.createDataFrame(long, "term int, parts int") if long else spark.createDataFrame([], "term int, parts int"))
        listed = members.join(asked, ["term", "id"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))).join(
            cut, "term", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("id"), "parts").cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        short = listed.filter("parts = 1").select("term", F.lit(0).alias("qb"), F.lit(0).alias("db"), "id", "asks", F.lit(True).alias("holds"))
        asking = listed.filter("parts > 1 AND asks").select("term", own.alias("qb"), every.alias("db"), "id", F.lit(True).alias("asks"), F.lit(False).alias("holds"))
        holding = listed.filter("parts > 1").select("term", every.alias("qb"), own.alias("db"), "id", F.lit(False).alias("asks"), F.lit(True).alias("holds"))
        dealt = short.union(asking.select(*short.columns)).union(holding.select(*short.columns)).join(self.rows, "id")
        return self._scored(dealt, k)

    def _scored(self, dealt: DataFrame, k: int) -> DataFrame:
        """The best ``k`` held rows of each asking row of a cell (term, qb, db)."""
        by = ["term", "qb", "db"]

        def run(batches):
            for t in _runs(batches, by):
                asks, holds = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "holds"))
                d = t.filter(pa.array(holds))
                if not asks.any() or not d.num_rows:
                    continue
                ids, rows, q = d.column("id").to_numpy(zero_copy_only=False), _rows(d), t.filter(pa.array(asks))
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1])))  # an id may repeat
                known = ids[order][first]
                for start in range(0, q.num_rows, _SLICE):
                    part = q.slice(start, _SLICE)
                    names = part.column("id").to_numpy(zero_copy_only=False)
                    scores = np.round(products(_rows(part), rows), _DIGITS)
                    scores = scores[:, order] if len(known) == len(ids) else np.maximum.reduceat(scores[:, order], first, axis=1)
                    scores[names[:, None] == known[None, :]] = -np.inf
                    best, found = best_columns(scores, k)
                    kept = found > -np.inf
                    if kept.any():
                        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(names, kept.sum(axis=1)),
                                                          "document_id": known[best[kept]], "score": found[kept]})
        cells = dealt.repartition(*by).sortWithinPartitions(*by)
        return cells.mapInArrow(run, f"query_id {self.id_type}, document_id {self.id_type}, score double")


def nearest(vectors: DataFrame, k: int, terms: int, key: str = "id", entries: str = "entries") -> DataFrame:
    """The ``k`` most similar other rows of every row: (query_id, document_id, score, rank); ties go to the lowest id.

    ``entries`` is an array of (index, value) with distinct indices below ``terms`` and values of 0 or more; rows have unit length or are empty.
    Rows that share no term have the score 0 and are taken, lowest id first, where fewer than k share one.
    """
    e = F.col(entries)
    rows = materialize(vectors.select(F.col(key).alias("id"), F.transform(e, lambda x: x["index"]).alias("index"),
                                      F.transform(e, lambda x: x["value"]).alias("value")), "sparse")
    lists, n = Lists(rows, terms), rows.count()
    blocks = lists.blocks(n)
    seeds = materialize(lists.asked(lambda i, v, n, w, f: seed_terms(i, v, n, w)), "seeds")
    if lists.sent(seeds) > 2 * n * blocks:
        return _best(lists.every(k, blocks), k)
    first = materialize(lists.compared(seeds, k), "floors")
    floors = _best(first, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("floor"))
    asked = materialize(lists.asked(needed_terms, floors.withColumnRenamed("query_id", "id")), "asked")
    if lists.sent(asked) > 2 * n * blocks:
        return _best(lists.every(k, blocks), k)
    more = lists.compared(asked, k)
    # rows without a common term score 0: the lowest ids are offered to rows that may share a term with fewer than k
    low = F.array(*[F.lit(r[0]) for r in rows.select("id").orderBy("id").limit(2 * k + 1).collect()] or [F.lit(None).cast(lists.id_type)])
    few = rows.select(F.col("id").alias("query_id")).join(floors.filter("floor > 0"), "query_id", "left_anti")
    filler = few.select("query_id", F.explode(low).alias("document_id"), F.lit(0.0).alias("score")).filter("query_id <> document_id")
    return _best(first.union(more).union(filler), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    each = found.groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
    return scaling.first_per_group(each, ["query_id"], [F.desc("score"), F.asc("document_id")], k)

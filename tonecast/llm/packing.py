"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by exact-complement hashing.

The plan is made on the number of pieces of each length only (at most ``capacity`` numbers): a length is combined with
one, two or three others that fill its gap exactly, as often as all of them are available, and what is left is placed
best fit. The plan lists patterns of lengths with a multiplicity; a piece finds its sequence from its rank among pieces
of its length. Ranks are a running number inside the task that cut the piece plus the counts of earlier tasks, so no
length gathers in one place.

Edge cases: a null text is empty; an empty text still has its end id and is a piece of length 1; longer documents
are cut and a text of any length is a slice of its own; pieces of equal length follow in the order of their task and rows;
repeated rows are packed row by row; an empty table gives no piece; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonecast.llm import arrowtext
from tonecast.llm.tokens import coder
from tonecast.session import materialize

CAPACITY = 2048
END_ID = 0


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, closed by ``END_ID``, into pieces of at most ``capacity``.

    Columns: doc_id, piece, start, length, ids_crc32, and for ranking task and turn (the number of earlier pieces of
    the same length in the task); with ``with_ids`` also ids.
    """
    schema = (f"{doc_id} long, piece int, start long, length long, ids_crc32 long, task int, turn long"
              + ", ids array<int>" * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turns = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        names = [x.split()[0] for x in schema.split(", ")]
        for rows, texts in arrowtext.text_slices(batches, text):
            ids, counts = coder(tokenizer).encode(texts)
            flat = np.insert(ids, np.cumsum(counts), np.uint32(END_ID)).astype("<u4")
            sizes = counts + 1
            cuts = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), cuts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            length = np.minimum(capacity, sizes[owner] - piece * capacity)
            first = np.cumsum(length) - length
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            run_length = np.bincount(length, minlength=capacity + 1)
            turn = np.empty(len(length), np.int64)
            turn[order] = np.arange(len(length)) - np.repeat(np.cumsum(run_length) - run_length, run_length)
            turn += turns[length]
            turns += run_length
            lists = [pa.ListArray.from_arrays(np.append(first, len(flat)).astype(np.int32), flat.view("<i4"))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(owner), task, np.int32)), pa.array(turn), *lists], names)
    return docs.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, schema)


class Stock:
    """How many pieces of each length are left, and the sequences planned so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        # indexes by sum: where the search for a pair, and for the first of three, goes on
        self.pair_from: dict[int, int] = {}
        self.triple_from: dict[int, int] = {}
        self.aside: set[int] = set()

    def take(self, lengths: tuple[int, ...]) -> bool:
        """Use a combination as often as the stock allows; False if it does not allow it once."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                self.left[x] -= times * k
            self.patterns.append((lengths, times))
        return times > 0

    @contextmanager
    def without(self, length: int) -> Iterator[None]:
        """One piece is set aside while its complements are looked up."""
        before = set(self.aside)
        self.left[length] -= 1
        self.aside.add(length)
        yield
        self.left[length] += 1
        self.aside = before

    def _pair(self, total: int, most: int) -> tuple[int, int] | None:
        """The pair of lengths in stock of the given sum whose larger one is largest, and at most ``most``.

        Stock only shrinks, so a pair that fails is not looked at again, unless it failed for a piece set aside.
        """
        big = min(self.pair_from.get(total, total - 1), total - 1)
        small = min(big, most)
        while 2 * small >= total:
            rest = total - small
            if self.left[small] > (small == rest) and self.left[rest]:
                return small, rest
            if small == big and not self.aside & {small, rest}:
                big = self.pair_from[total] = big - 1
            small -= 1
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths in stock with the sum ``gap``, the first ones as large as can be."""
        if gap >= 1 and self.left[gap]:
            return (gap,)
        if pair := self._pair(gap, gap):
            return pair
        while 3 * (first := self.triple_from.get(gap, gap - 2)) >= gap and first > 0:
            if self.left[first]:
                with self.without(first):
                    pair = self._pair(gap - first, first)
                if pair:
                    return (first, *pair)
            self.triple_from[gap] = first - 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths (sum at most ``capacity``) with their multiplicity that use up all ``counts``."""
    stock = Stock(counts, capacity)
    for length in range(capacity, capacity // 4, -1):
        going = True
        while going and stock.left[length]:
            if length == capacity:
                going = stock.take((length,))
                continue
            with stock.without(length):
                found = stock.complement(capacity - length)
            going = found is not None and stock.take((length, *found))
    # best fit of the rest, longest first, on groups of equal sequences by their gap
    gaps: dict[int, Counter] = defaultdict(Counter)
    for length in range(capacity, 0, -1):
        while left := int(stock.left[length]):
            gap = min((g for g in gaps if g >= length), default=capacity)
            group = next(iter(gaps[gap])) if gap in gaps else ()
            held = gaps[gap][group] if group else left
            each = min(gap // length, left)
            times = min(held, left // each)
            if group:
                gaps[gap][group] -= times
                if not gaps[gap][group]:
                    del gaps[gap][group]
                if not gaps[gap]:
                    del gaps[gap]
            stock.left[length] -= times * each
            rest = gap - each * length
            if rest:
                gaps[rest][(*group, *[length] * each)] += times
            else:
                stock.patterns.append(((*group, *[length] * each), times))
    return stock.patterns + [(p, n) for groups in gaps.values() for p, n in groups.items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length rows (first rank, first sequence, pieces per sequence, offset), in order of rank."""
    ranks, rows, sequence = Counter(), defaultdict(list), 0
    for lengths, times in patterns:
        offset = 0
        for length, each in Counter(lengths).items():
            rows[length].append((ranks[length], sequence, each, offset))
            ranks[length] += each * times
            offset += each * length
        sequence += times
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset: gapless from 0 in each sequence, at most ``capacity`` long together."""
    cut = materialize(pieces(docs, tokenizer, capacity, doc_id, text, with_ids), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    totals = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = cut.sparkSession.sparkContext.broadcast(places(plan(totals, capacity)))
    before = by_task.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(before.select("task", "length", "before"), ["task", "length"]).withColumn(
        "rank", F.coalesce("before", F.lit(0)) + F.col("turn")).drop("task", "turn", "before")
    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["sequence_id long", "offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                own, rows = length == size, table[size]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                turn = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + turn // row[:, 2]
                offset[own] = row[:, 3] + turn % row[:, 2] * size
            kept = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)],
                                             [*(f.name for f in fields), "sequence_id", "offset"])
    return ranked.mapInArrow(run, schema)

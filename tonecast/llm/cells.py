"""Exact links between sets of shingles inside groups of candidates, without a row per pair.

Candidates that any edge connects form a group. A group is dealt into blocks of a bounded number of members and shingles,
and each pair of blocks is a cell, the work of one task: it holds the whole sets of its members, passes over pairs that a
cheap test or the links found so far make needless, counts the others' intersections and gives back the links of a
spanning forest only. So rows stay linear in the members; comparisons are the square of a group's size at worst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.llm import arrowtext
from tonecast.llm.components import components
from tonecast.llm.shingles import Similarity
from tonecast.operators.scaling import join_hot_keys
from tonecast.session import materialize

MEMBERS = 4096
SHINGLES = 4 << 20
_BROADCAST_ROWS = 100_000
_GATHER = 4 << 20  # shingles looked up at once

#: Given sizes in ascending order and the marks of the members, tells which of the members js may be linked to k.
Test = Callable[[int, np.ndarray], np.ndarray]


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows, cut so that rows of equal ``by`` stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for name in by:
            v = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        if held and any(held[-1].column(held[-1].schema.get_field_index(n))[-1].as_py()
                        != batch.column(batch.schema.get_field_index(n))[0].as_py() for n in by):
            yield pa.Table.from_batches(held)
            held = []
        at = np.flatnonzero(change)
        if len(at):
            yield pa.Table.from_batches([*held, batch.slice(0, int(at[-1]) + 1)])
            held = [batch.slice(int(at[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
    arrowtext.release()


def cuts(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of each run of equal rows."""
    change = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    at = (np.flatnonzero(change) + 1).tolist()
    return list(zip([0, *at], [*at, len(columns[0])], strict=True))


class Sets:
    """The members' sets, coded densely, for counting intersections of one with many."""

    def __init__(self, sets: pa.Array):
        self.at = np.concatenate(([0], np.cumsum(pc.list_value_length(sets).to_numpy()))).astype(np.int64)
        distinct, self.codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        self.flag = np.zeros(len(distinct), bool)

    def shared(self, k: int, js: np.ndarray) -> np.ndarray:
        own = self.codes[self.at[k]:self.at[k + 1]]
        self.flag[own] = True
        out = np.zeros(len(js), np.int64)
        size = self.at[js + 1] - self.at[js]
        ends = np.cumsum(size)
        start = 0
        while start < len(js):
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + _GATHER, side="right")))
            n = size[start:stop]
            first = np.cumsum(n) - n
            places = np.repeat(self.at[js[start:stop]] - first, n) + np.arange(int(n.sum()))
            out[start:stop] = np.add.reduceat(self.flag[self.codes[places]].astype(np.int32), first)
            start = stop
        self.flag[own] = False
        return out


def forest(size: np.ndarray, block: np.ndarray, sets: Sets, test: Test, sim: Similarity) -> Iterator[tuple[int, int]]:
    """Links that connect what linked pairs connect, members being in ascending order of ``size``.

    Of members of two blocks only pairs across them are told: pairs inside a block have a cell of their own.
    """
    label, limit = np.arange(len(size)), np.searchsorted(size, sim.top(size), side="right")
    across = len(np.unique(block)) > 1
    for k in range(len(size) - 1):
        js = np.arange(k + 1, int(limit[k]))
        open_ = label[js] != label[k]
        if across:
            open_ &= block[js] != block[k]
        js = js[open_]
        if len(js):
            js = js[test(k, js)]
        if len(js):
            js = js[sim.linked(size[k], size[js], sets.shared(k, js))]
        if len(js):
            others, first = np.unique(label[js], return_index=True)
            yield from ((k, int(js[i])) for i in first)
            label[np.isin(label, others)] = label[k]


def linked_names(edges: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], sim: Similarity,
                 test: Callable[[np.ndarray, list[bytes]], Test]) -> DataFrame:
    """(node, component) of the nodes that ``edges`` (a, b) touch, components being those of the linked pairs.

    Every linked pair must be connected by ``edges``. ``nodes`` has uid, size, mark and what ``sets`` needs to look up the
    whole sets (uid, set) of some nodes; ``test`` makes the cheap test of a cell from its sizes and marks.
    """
    groups = components(edges).select(F.col("node").alias("uid"), F.col("component").alias("cell"))
    members = materialize(nodes.join(groups, "uid"), "members")
    parts = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("size") / SHINGLES)).cast("int")
    large = members.groupBy("cell").agg(parts.alias("parts")).where("parts > 1")
    rows = members.select("uid", "size", "mark", "cell")
    if large.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS:
        dealt = rows.join(F.broadcast(large), "cell", "left")
    else:
        dealt = join_hot_keys(rows, large, "cell")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("uid"), "parts").cast("int")).join(sets(members), "uid")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("cell", "uid", "size", "mark", "set", "block", other).select(
        "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "uid", "size", "mark",
        "set", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["cell", "low", "high"]):
            t = t.combine_chunks()
            ends = cuts(*(t.column(c).to_numpy() for c in ("cell", "low", "high")))
            found: list[tuple[int, int]] = []
            for start, stop in ends:
                if stop - start < 2:
                    continue
                own = t.slice(start, stop - start)
                order = np.argsort(own.column("size").to_numpy(), kind="stable")
                own = own.take(pa.array(order)).combine_chunks()
                uid, size = own.column("uid").to_numpy(), own.column("size").to_numpy()
                links = forest(size, own.column("block").to_numpy(), Sets(own.column("set").chunk(0)),
                               test(size, own.column("mark").to_pylist()), sim)
                found += [(int(uid[i]), int(uid[j])) for i, j in links]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
    cells = dealt.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return components(materialize(cells.mapInArrow(run, "a long, b long"), "links"))

"""Prefix trie of conversations by vertical bitmaps.

Conversations become keys of one digest per turn and are sorted by key and id, so that a shard of consecutive ones holds
every node whole but for those on the paths of its first and last conversation. A shard indexes (position, turn) to the
bitset of its conversations; the members of a child are the parent's bitset and the posting of its turn, and a depth-first
walk gives children, popcounts, end lists and, on the way back, sums over subtrees.

Nodes inside a shard are final. Open ones, on its outer paths, are added up over shards; what two neighbouring shards both
counted (shared nodes, a last turn that the next shard goes on from) is subtracted by their common prefix, which a task
knows for its own shards and one row per task tells across tasks. So a turn, a prefix or a whole conversation that a third
of all have is spread like any other, and no subtree gathers anywhere. The id lists of open nodes pass in chunks, in order,
through one running hash per node, as the asked SHA-256 of a list demands.

Edge cases: rows without conv_id belong to no conversation and are left out; a null role or text is empty; a null turn comes
first; rows of equal turn, repeated ones too, follow in the order of their digest; a conversation is one row (its digests,
16 bytes a turn, are held together), texts of any length count by digest and number of words; an empty table has no node;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonecast.llm.cells import runs
from tonecast.session import materialize

CONVERSATIONS, TURNS = 4096, 1 << 16  # bounds of a shard
WIDTH = 16  # bytes of a turn's digest
LONGEST_START = 3  # most turns that a conversation takes over
_BROADCAST_ROWS = 200_000


def shared_starts(conv_id: Column) -> tuple[Column, Column]:
    """The conversation whose first turns another takes over, and how many."""
    return conv_id - conv_id % 20, (F.crc32(conv_id.cast("string")) % 4).cast("int")


def rebuilt(turns: DataFrame, starts: Callable[[Column], tuple[Column, Column]] = shared_starts) -> DataFrame:
    """conv_id, key (digests of the turns one after another) and words (per turn) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("code"),
                    F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    base, taken = starts(F.col("conv_id"))
    # one shuffle by the source of the first turns serves the grouping and the join
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").where("conv_id IS NOT NULL").select(
        "conv_id", base.alias("base"), turn.alias("turn")).repartition("base")
    own = rows.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    heads = own.where("conv_id = base").select(F.col("base").alias("of"), F.slice("turns", 1, LONGEST_START).alias("head"))
    n = F.least(taken, F.lit(LONGEST_START))
    whole = F.concat(F.slice(F.coalesce("head", F.expr("slice(turns, 1, 0)")), F.lit(1), n),
                     F.slice("turns", n + 1, F.size("turns")))
    return own.join(heads, F.col("base") == F.col("of"), "left").select("conv_id", whole.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), "")).alias("key"),
        F.transform("turns", lambda t: t["words"]).alias("words"))


@dataclass
class Shard:
    """Conversations in order of key, then id."""
    keys: list[bytes]
    ids: list[int]
    words: list[list[int]]

    def nodes(self) -> Iterator[dict]:
        """Every node of the shard's own trie, children before their parent."""
        postings: dict[tuple[int, bytes], int] = {}
        ends: dict[int, int] = {}
        for i, key in enumerate(self.keys):
            bit = 1 << i
            depth = len(key) // WIDTH
            for d in range(depth):
                at = (d, key[d * WIDTH:(d + 1) * WIDTH])
                postings[at] = postings.get(at, 0) | bit
            ends[depth] = ends.get(depth, 0) | bit
        edges = (self.keys[0], self.keys[-1])

        def opened(members: int, depth: int) -> dict:
            some = _lowest(members)
            path = self.keys[some][:depth * WIDTH]
            here = members & ends.get(depth, 0)
            return {"depth": depth, "path": path, "members": members, "rest": members ^ here, "ends": _bits(here),
                    "open": any(e.startswith(path) for e in edges), "words": self.words[some][depth - 1] if depth else 0,
                    "n_children": 0, "n_leaves": 0, "below": 0, "least": None, "children": []}
        stack = [opened((1 << len(self.keys)) - 1, 0)]
        while stack:
            top = stack[-1]
            if top["rest"]:
                depth, some = top["depth"], _lowest(top["rest"])
                code = self.keys[some][depth * WIDTH:(depth + 1) * WIDTH]
                child = top["members"] & postings[depth, code]
                top["rest"] ^= child
                stack.append(opened(child, depth + 1))
                continue
            stack.pop()
            own = [self.ids[i] for i in top["ends"]]
            n = top["members"].bit_count()
            least = min([*own, *([top["least"]] if top["least"] is not None else [])])
            node = {"path": top["path"], "depth": top["depth"], "open": top["open"], "conv_id": least, "n_convs": n,
                    "n_children": top["n_children"], "n_leaves": top["n_leaves"] or 1,
                    "saved_tokens": top["below"] + (n - 1) * top["words"], "ends": own, "children": top["children"]}
            if stack:
                up = stack[-1]
                up["n_children"] += 1
                up["n_leaves"] += node["n_leaves"]
                up["below"] += node["saved_tokens"]
                up["least"] = least if up["least"] is None else min(up["least"], least)
                if not top["open"]:
                    up["children"].append(node)
            yield node


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _bits(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share from the start."""
    n = 0
    while n < min(len(a), len(b)) and a[n:n + WIDTH] == b[n:n + WIDTH]:
        n += WIDTH
    return n // WIDTH


def corrections(before: bytes, after: bytes, words: list[int]) -> Iterator[tuple[bytes, int, int, int, int]]:
    """What to add to the nodes that hold both the last of a shard and the first of the next (whose words are given).

    Rows of path, depth, n_children, n_leaves and saved_tokens.
    """
    shared = common(before, after)
    goes_on = -1 if shared == len(before) // WIDTH else 0  # then the earlier shard took an inner or equal node for a leaf
    below = 0
    for depth in range(shared, -1, -1):
        below += words[depth - 1] if depth else 0
        yield after[:depth * WIDTH], depth, -1 if depth < shared else 0, goes_on, below


def _digest(path: bytes) -> bytes:
    return hashlib.md5(path).digest() + len(path).to_bytes(4, "big")


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


_ROW = [("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.string()), ("task", pa.int64()),
        ("shard", pa.int64()), ("first", pa.binary()), ("first_words", pa.list_(pa.int64())), ("last", pa.binary())]
_SCHEMA = ("node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
           "n_leaves long, saved_tokens long, ends_sha256 string, ends string, task long, shard long, first binary, "
           "first_words array<long>, last binary")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _ROW], [n for n, _ in _ROW])


def _correction_rows(before: bytes, after: bytes, words: list[int]) -> Iterator[dict]:
    for path, depth, children, leaves, saved in corrections(before, after, words):
        yield {"node": _digest(path), "depth": depth, "n_convs": 0, "n_children": children, "n_leaves": leaves,
               "saved_tokens": saved}


def _node_rows(shard: Shard, task: int, number: int) -> Iterator[dict]:
    for node in shard.nodes():
        depth, path = node["depth"], node["path"]
        row = {k: node[k] for k in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")}
        row["parent"] = _digest(path[:-WIDTH]) if depth else None
        if node["open"]:
            yield row | {"node": _digest(path), "ends": _joined(node["ends"]) if node["ends"] else None, "task": task,
                         "shard": number}
            # final children of an open parent learn its id later
            below = [(c, None, _digest(path)) for c in node["children"]]
        else:
            below = [(c, node["conv_id"], None) for c in node["children"]]
        for child, up, parent in below:
            yield {k: child[k] for k in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")} | {
                "parent_conv_id": up, "parent": parent,
                "ends_sha256": hashlib.sha256(_joined(child["ends"]).encode()).hexdigest()}
        node["children"] = []


def _tries(sequences: DataFrame) -> DataFrame:
    """Rows of four kinds: final nodes (node is null), parts of open nodes (n_convs > 0), corrections of open nodes
    (n_convs = 0), and the first and last key of each task (depth is null)."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held, turns = Shard([], [], []), 0
        for batch in batches:
            for key, cid, words in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "words")), strict=True):
                if held.keys and (len(held.keys) >= CONVERSATIONS or turns + len(words) > TURNS):
                    yield held
                    held, turns = Shard([], [], []), 0
                held.keys.append(key)
                held.ids.append(cid)
                held.words.append(words)
                turns += len(words)
        if held.keys:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, last = TaskContext.get().partitionId(), None, None
        for number, shard in enumerate(shards(batches)):
            rows = list(_node_rows(shard, task, number))
            if last is None:
                first = {"first": shard.keys[0], "first_words": shard.words[0]}
            else:
                rows += _correction_rows(last, shard.keys[0], shard.words[0])
            last = shard.keys[-1]
            for k in range(0, len(rows), 10_000):
                yield _batch(rows[k:k + 10_000])
        if first is not None:
            yield _batch([first | {"last": last, "task": task}])
    ranged = sequences.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return ranged.mapInArrow(run, _SCHEMA)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for x in batch.to_pylist() for r in _correction_rows(x["before"], x["first"], x["first_words"])]
        if rows:
            yield _batch(rows)


def _running_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash over the chunks of each node, which follow each other in order."""
    node, state = None, None
    for batch in batches:
        out = []
        for own, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if own != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())],
                                         ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def build(turns: DataFrame, starts: Callable[[Column], tuple[Column, Column]] = shared_starts) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256 of the ids that end there."""
    sequences = materialize(rebuilt(turns, starts), "sequences")
    found = materialize(_tries(sequences), "tries")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    empty = hashlib.sha256(b"").hexdigest()
    # one row per task
    pairs = found.where("first IS NOT NULL").select("task", "first", "first_words", F.lag("last").over(Window.orderBy("task")).alias("before"))
    across = pairs.where("before IS NOT NULL").select("before", "first", "first_words").mapInArrow(_across, _SCHEMA)
    parts = found.where("node IS NOT NULL")
    chunks = parts.where("ends IS NOT NULL").select("node", "task", "shard", "ends")
    hashes = chunks.repartition("node").sortWithinPartitions("node", "task", "shard").mapInArrow(
        _running_hash, "node binary, ends_sha256 string")
    merged = parts.select("node", "parent", "conv_id", "depth", *sums).union(
        across.select("node", "parent", "conv_id", "depth", *sums)).groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in sums)).join(hashes, "node", "left")
    opened = materialize(merged, "open")
    ids = opened.select(F.col("node").alias("up"), F.col("conv_id").alias("up_id"))
    if ids.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS:
        ids = F.broadcast(ids)
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    final = found.where("node IS NULL AND depth IS NOT NULL")
    inner = final.where("parent IS NULL").select(*columns)
    outer = final.where("parent IS NOT NULL").select("parent", *columns).drop("parent_conv_id").unionByName(
        opened.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).drop("node"))
    named = outer.join(ids, F.col("parent") == F.col("up"), "left").withColumn("parent_conv_id", F.col("up_id"))
    return inner.union(named.select(*columns))

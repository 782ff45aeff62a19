"""Near duplicates by SetSketch registers.

A register holds on an exponential scale, truncated to 16 bits, the least of exponentially distributed values of a set's
elements, so the sketch of a union is the register-wise maximum and registers of similar sets agree about as often as the
Jaccard similarity says. Bands of registers are hashed; members of a band value, in order of size, are chained to their
neighbours as long as sizes fit, which keeps the rows linear and connects every pair that shares a band. Inside what the
chains connect, pairs are judged by the joint likelihood of their registers and sizes, and those that may be linked are
confirmed on their whole sets (``cells``). A pair is missed only if it shares no band: at 0.85 and the default of 40 bands
of 8 registers that is one in 300,000; the likelihood passes over a linked pair about once in 10^7.

Edge cases: null or empty texts and texts without words have size 0, are linked with nothing and kept; fewer words than a
shingle make one shingle; equal sets, repeated rows among them, fall into one component; a null id counts as the largest, so
a component is named by it only if no member has an id; very long texts are one row like any other; an empty table gives no
row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonecast.llm import arrowtext
from tonecast.llm.cells import linked_names
from tonecast.llm.shingles import Similarity, digest, shingle_sets, whole_sets
from tonecast.session import materialize

REGISTERS = 320
ROWS = 8  # registers of a band
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
DOUBT = 16.0  # log-likelihood ratio beyond which a pair is held to be below the threshold
_CHUNK = 1 << 15  # shingles hashed at once


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """(set, register): 0 for the empty set, else from the least value of each register's hash."""
    out = np.zeros((len(sets), m), np.uint16)
    turns = arrowtext.mix64(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)
    used = [i for i, s in enumerate(sets) if len(s)]
    while used:
        total, n = 0, 0
        while n < len(used) and (n == 0 or total + len(sets[used[n]]) <= _CHUNK):
            total += len(sets[used[n]])
            n += 1
        rows, used = used[:n], used[n:]
        whole = np.concatenate([sets[i] for i in rows])
        starts = np.cumsum([0, *(len(sets[i]) for i in rows[:-1])])
        least, held = np.empty((m, n), np.uint64), np.empty_like(whole)
        for i in range(m):
            np.multiply(whole, turns[i], out=held)
            np.minimum.reduceat(held, starts, out=least[i])
        with np.errstate(divide="ignore"):
            # the least of exponential values is the exponential value of the least uniform one
            value = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
            out[rows] = np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers (a multiple of four)."""
    words = sketch.astype("<u2").view("<u8").reshape(len(sketch), -1, rows // 4)
    key = np.broadcast_to(arrowtext.mix64(np.arange(1, words.shape[1] + 1, dtype=np.uint64)), words.shape[:2])
    for k in range(words.shape[2]):
        key = arrowtext.mix64(key ^ arrowtext.mix64(words[:, :, k] + np.uint64(k + 1)))
    return key


def _larger(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set is larger, x being its share of the union less the other's."""
    return -np.log1p(-np.clip(x, 0, None) * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(j, up, down, equal, u):
    """Of the similarity j, when ``up`` registers are larger in the set that has the share u of both sizes, and so on."""
    a, b = _larger(u - (1 - u) * j), _larger((1 - u) - u * j)
    out = 0.0
    for count, p in ((up, a), (down, b), (equal, 1 - a - b)):
        out = out + np.where(count > 0, count * np.log(np.maximum(p, 1e-300)), 0.0)
    return out


def estimate(up, down, equal, n, m) -> np.ndarray:
    """Most likely similarity of sets of sizes n and m, by golden section (the likelihood has one peak)."""
    u = n / (n + m)
    low, high = np.zeros_like(u, dtype=float), np.minimum(u / (1 - u), (1 - u) / u)
    step = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        a, b = high - step * (high - low), low + step * (high - low)
        left = log_likelihood(a, up, down, equal, u) > log_likelihood(b, up, down, equal, u)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


class Sketches:
    """The members' registers; tells whom the joint likelihood lets be linked to a member."""

    def __init__(self, size: np.ndarray, marks: list[bytes], sim: Similarity):
        self.size, self.least = size.astype(float), sim.part / sim.whole
        self.registers = np.frombuffer(b"".join(marks), "<u2").reshape(len(marks), -1)
        m = self.registers.shape[1]
        # agreements that a linked pair has but for one case in 10^13
        self.equal = m * self.least - 7.5 * math.sqrt(m * self.least * (1 - self.least))

    def __call__(self, k: int, js: np.ndarray) -> np.ndarray:
        own, others = self.registers[k], self.registers[js]
        equal = (others == own).sum(axis=1)
        out = equal >= self.equal
        near = np.flatnonzero(out)
        if len(near):
            equal, n, m = equal[near], np.full(len(near), self.size[k]), self.size[js[near]]
            up = (own > others[near]).sum(axis=1)
            down = len(own) - equal - up
            best = estimate(up, down, equal, n, m)
            u = n / (n + m)
            lost = log_likelihood(best, up, down, equal, u) - log_likelihood(self.least, up, down, equal, u)
            out[near] = (best >= self.least) | (lost <= DOUBT)
        return out


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sim: Similarity = Similarity(),
             m: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """doc_id, uid (unique), size, node (digest of the set), mark (registers) and keys (one per band) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for given, texts in arrowtext.text_slices(batches, text):
            sets = list(shingle_sets(texts, sim.words))
            sketch = registers(sets, m)
            keys = band_keys(sketch, rows).view(np.int64)
            some = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [given.column(0), pa.array(uid + np.arange(len(sets))), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest(s) for s in sets], pa.binary()),
                 pa.array([x.astype("<u2").tobytes() if y else None for x, y in zip(sketch, some, strict=True)], pa.binary()),
                 pa.array([x if y else None for x, y in zip(keys, some, strict=True)], pa.list_(pa.int64()))],
                ["doc_id", "uid", "size", "node", "mark", "keys"])
            uid += len(sets)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text))
    return source.mapInArrow(run, "doc_id long, uid long, size long, node binary, mark binary, keys array<long>")


def chained(postings: DataFrame, sim: Similarity) -> DataFrame:
    """Edges (a, b) between neighbours, by size, of equal key whose sizes fit; ``postings`` has key, size and uid.

    Postings are sorted in ranges, so a key of any number of members is spread over tasks. The last row of a task and
    the first of the next are joined from one row per task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, size, uid = (batch.column(c).to_numpy() for c in range(3))
            if last is None:
                first = (key[0], size[0], uid[0])
            else:
                key, size, uid = (np.concatenate(([x], y)) for x, y in zip(last, (key, size, uid), strict=True))
            last = (key[-1], size[-1], uid[-1])
            near = np.flatnonzero((key[1:] == key[:-1]) & (size[1:] <= sim.top(size[:-1])) & (uid[1:] != uid[:-1]))
            edges = np.unique(np.sort(np.stack((uid[near], uid[near + 1])), axis=0), axis=1)
            none = pa.nulls(edges.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1]), *[none] * 7], names)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([None if x is None else int(x)], pa.int64())
                                              for x in (None, None, task, *first, *last)], names)
    names = ["a", "b", "task", "key", "size", "uid", "last_key", "last_size", "last_uid"]
    ranged = postings.select("key", "size", "uid").repartitionByRange("key", "size", "uid").sortWithinPartitions("key", "size", "uid")
    found = materialize(ranged.mapInArrow(run, ", ".join(f"{n} long" for n in names)), "chains")
    order = Window.orderBy("task")  # one row per task
    before = {c: F.lag(f"last_{c}").over(order).alias(f"before_{c}") for c in ("key", "size", "uid")}
    across = found.where("task IS NOT NULL").select("key", "size", "uid", *before.values()).where(
        (F.col("before_key") == F.col("key")) & (F.col("size") * sim.part <= F.col("before_size") * sim.whole))
    return found.where("task IS NULL").select("a", "b").union(across.select("before_uid", "uid"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sim: Similarity = Similarity(),
                    m: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, size (distinct shingles), component_id (smallest linked doc_id)."""
    with arrowtext.small_batches(docs.sparkSession):
        return _near_duplicates(docs, doc_id, text, sim, m, rows)


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, sim: Similarity, m: int, rows: int) -> DataFrame:
    profiles = materialize(sketched(docs, doc_id, text, sim, m, rows), "sketches")
    least = F.min_by(F.struct("doc_id", "uid"), F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))
    firsts = materialize(profiles.where("node IS NOT NULL").groupBy("node").agg(least.alias("f")).select(
        "node", F.col("f.doc_id").alias("first"), F.col("f.uid").alias("uid")), "firsts")
    nodes = profiles.drop("node", "doc_id").join(firsts, "uid")
    postings = materialize(nodes.select(F.explode("keys").alias("key"), "size", "uid"), "bands")
    names = linked_names(chained(postings, sim), nodes.drop("keys"), lambda wanted: whole_sets(docs, wanted, doc_id, text, sim),
                         sim, lambda size, marks: Sketches(size, marks, sim))
    named = firsts.join(names.withColumnRenamed("node", "uid"), "uid", "left").withColumn(
        "component", F.coalesce("component", "uid"))
    leads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = named.join(leads, "component").select("node", "component_id")
    return profiles.select("doc_id", "size", "node").join(of_node, "node", "left").select(
        "doc_id", "size", F.coalesce("component_id", "doc_id").alias("component_id"))

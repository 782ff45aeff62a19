"""Exact n-gram Jaccard join by a size-aware split into light and heavy sets, and the groups it links.

A document is the set of its word shingles. Shingles are ordered by how often they occur (counted over all documents in
a fixed number of hash buckets), frequent ones last. Two sets of the asked similarity share at least two of the first
``p + 1`` shingles and one of the first ``p``, where p follows from the size. Light sets enumerate the subsets of two,
which are selective but many; heavy sets go into the inverted lists of single shingles, which are few but longer to
scan. The boundary is the size at which both cost the same, given the mean length of a list; sets near it do both.

Equal sets are one node. Inside a list (cut into blocks, so that no task holds a long one) pairs are tested by size and
by a parity bitmap, whose differing bits never exceed the symmetric difference; only a spanning forest of the survivors
is kept. What these forests connect is a group, and inside each group the whole sets are compared (``cells``), so no link
is lost and no group is expanded into pairs.

Sets are compared by 64-bit hashes of their shingles and are equal when their 128-bit digests are.

Edge cases: null or empty texts and texts without words have size 0 and are linked with nothing; fewer words than a
shingle make one shingle; repeated rows fall into one group; a null id counts as the largest, so a group is named by it only
if no member has an id; of ties the row first read leads; very long texts are one row like any other; an empty table gives
no row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.llm import arrowtext
from tonecast.llm.cells import cuts, linked_names, runs
from tonecast.llm.shingles import Similarity, digest, shingle_sets, whole_sets
from tonecast.session import materialize

BUCKETS = 1 << 16
BLOCK = 2048
SCAN_COST = 0.25  # cost of testing one posting of a list over that of emitting one key


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of hash buckets: two to four buckets per shingle in small sets, in larger ones enough for unrelated sets
    to differ in more buckets than linked ones may."""
    n = len(shingles)
    width = max(64, min(1 << (2 * n - 1).bit_length(), max(1024, 1 << (n // 2).bit_length())))
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _frequencies(docs: DataFrame, text: str, sim: Similarity) -> np.ndarray:
    """Shingles per hash bucket, counted over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, texts in arrowtext.text_slices(batches, text):
            total += np.bincount(_bucket(np.concatenate(list(shingle_sets(texts, sim.words)))), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])
    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def boundary(frequencies: np.ndarray, sim: Similarity) -> int:
    """Largest size of a light set: its subsets cost no more than its postings and the lists they make it scan."""
    counts = np.sort(frequencies[frequencies > 0]).astype(float)
    rare = counts[:1 + int(np.searchsorted(np.cumsum(counts), counts.sum() * (1 - sim.part / sim.whole)))]
    # what the spread of the counts shows beyond an even deal; prefixes are filled from the rarest buckets
    shared = max(0.0, float((rare ** 2).sum() / rare.sum() - rare.mean())) if len(rare) else 0.0
    size = 1
    while size < 1 << 20 and (sim.prefix(size + 1) + 1) / 2 <= 1 + SCAN_COST * shared:
        size += 1
    return size


def keys_of(shingles: np.ndarray, rank: np.ndarray, light: int, sim: Similarity) -> np.ndarray:
    """Subsets of two (light sets) and single shingles (heavy sets and sets that a heavy one may link to)."""
    n = len(shingles)
    if n == 0:
        return np.zeros(0, np.uint64)
    p = sim.prefix(n)
    order = np.argsort((rank[_bucket(shingles)] << np.uint64(48)) | (shingles >> np.uint64(16)), kind="stable")
    first = shingles[order[:p + 1]]
    out = []
    if n <= light:
        i, j = np.triu_indices(len(first), 1)
        a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        out.append(arrowtext.mix64(a * np.uint64(3) + arrowtext.mix64(b)))
    if sim.top(n) > light:
        out.append(arrowtext.mix64(first[:p] + np.uint64(1)))
    return np.unique(np.concatenate(out))


def _profiles(docs: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """doc_id, uid (unique), size, node, bits and keys of every document."""
    counts = _frequencies(docs, text, sim)
    shift = max(0, int(counts.max(initial=0)).bit_length() - 16)
    shared = docs.sparkSession.sparkContext.broadcast(((counts >> shift).astype(np.uint64), boundary(counts, sim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, light = shared.value
        uid = TaskContext.get().partitionId() << 40
        for rows, texts in arrowtext.text_slices(batches, text):
            size, node, bits, keys = [], [], [], []
            for s in shingle_sets(texts, sim.words):
                size.append(len(s))
                node.append(digest(s))
                bits.append(bitmap(s) if len(s) else None)
                keys.append(keys_of(s, rank, light, sim).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(uid + np.arange(len(size))), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(bits, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), rows.column(2)], ["doc_id", "uid", "size", "node", "bits", "keys", "text_hash"])
            uid += len(size)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text), F.xxhash64(text).alias("text_hash"))
    return source.mapInArrow(run, "doc_id long, uid long, size long, node binary, bits binary, keys array<long>, text_hash long")


def _shared_keys(postings: DataFrame, sim: Similarity) -> DataFrame:
    """Postings whose key another set of a fitting size has; one key after another streams through its task.

    In order of size a set has a fitting partner if and only if a neighbour fits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, fitted = None, False  # the last row, and whether it fits the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*([waiting] if waiting is not None else []), batch]).combine_chunks()
            batch = whole.to_batches()[0]
            key, size = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            fits = (key[1:] == key[:-1]) & (size[1:] <= sim.top(size[:-1]))
            kept = np.concatenate(([fitted], fits)) | np.concatenate((fits, [False]))
            waiting, fitted = batch.slice(len(key) - 1), bool(fits[-1]) if len(fits) else fitted
            yield batch.slice(0, len(key) - 1).filter(pa.array(kept[:-1]))
        if waiting is not None and fitted:
            yield waiting
    return postings.repartition("key").sortWithinPartitions("key", "size").mapInArrow(run, postings.schema).drop("size")


def _blocks(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of each list with size and bits; lists of more than ``BLOCK`` members are dealt into pairs of blocks."""
    long = postings.groupBy("key").count().where(F.col("count") > BLOCK).select(
        "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = postings.join(long, "key", "left").withColumn("block", F.pmod(F.xxhash64("uid"), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    return dealt.select("key", "uid", "block", other).select(
        "key", "uid", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    ).join(nodes.select("uid", "size", "bits"), "uid")


def _fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) ^ (bits & ((1 << width) - 1))
    return bits


class Bitmaps:
    """Bitmaps of the members of a list, in ascending order of size, folded to each width in use."""

    def __init__(self, size: np.ndarray, bits: list[bytes], sim: Similarity):
        self.size, self.sim = size, sim
        self.width = np.array([len(b) * 8 for b in bits])
        self.packed: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            rows = [_fold(int.from_bytes(b, "little"), len(b) * 8, w).to_bytes(w // 8, "little") if len(b) * 8 >= w
                    else bytes(w // 8) for b in bits]
            self.packed[w] = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)

    def __call__(self, k: int, js: np.ndarray) -> np.ndarray:
        """Which of the larger members js differ from k by no more than linked sets may."""
        m = self.packed[int(self.width[k])]
        differ = np.bitwise_count(m[js] ^ m[k]).sum(axis=1, dtype=np.int64)
        return differ <= self.sim.slack(self.size[k], self.size[js])


def candidates(size: np.ndarray, block: np.ndarray, test: Bitmaps, sim: Similarity) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that size and bitmap let pass; only pairs across two blocks, if two."""
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
            others, first = np.unique(label[js], return_index=True)
            yield from ((k, int(js[i])) for i in first)
            label[np.isin(label, others)] = label[k]


def _scan(lists: DataFrame, sim: Similarity) -> DataFrame:
    """Edges (a, b): a spanning forest of the pairs of each list that pass the test."""
    columns = ["key", "low", "high", "uid", "size", "bits", "block"]
    dealt = lists.select(*columns).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "low", "high"]):
            ends = cuts(*(t.column(c).to_numpy() for c in ("key", "low", "high")))
            uid, bits = t.column("uid").to_numpy(), t.column("bits").to_pylist()
            size, block = t.column("size").to_numpy(), t.column("block").to_numpy()
            edges: list[tuple] = []
            for a, b in ends:
                if b - a < 2:
                    continue
                order = a + np.argsort(size[a:b], kind="stable")
                test = Bitmaps(size[order], [bits[i] for i in order], sim)
                own = uid[order].tolist()
                edges += [(min(own[i], own[j]), max(own[i], own[j]))
                          for i, j in candidates(size[order], block[order], test, sim)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*set(edges), strict=True)], ["a", "b"])
    return dealt.mapInArrow(run, "a long, b long")


def linked_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sim: Similarity = Similarity()) -> DataFrame:
    """One row per document: doc_id, size (distinct shingles), component_id (smallest linked doc_id), text_hash (Spark's
    xxhash64 of the text) and leads (true for one row of each component, of the smallest id; for every row of size 0)."""
    with arrowtext.small_batches(docs.sparkSession):
        return _linked_groups(docs, doc_id, text, sim)


def _linked_groups(docs: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    profiles = materialize(_profiles(docs, doc_id, text, sim), "profiles")
    least = F.min_by(F.struct("doc_id", "uid"), F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))
    firsts = profiles.where("node IS NOT NULL").groupBy("node").agg(least.alias("f")).select("node", "f.doc_id", "f.uid")
    firsts = firsts.withColumnRenamed("doc_id", "first")
    # one shuffle of bitmaps and keys serves everything that reads them
    nodes = materialize(profiles.drop("node", "doc_id", "text_hash").join(firsts, "uid"), "nodes")
    postings = nodes.select(F.explode("keys").alias("key"), "uid", F.col("size").cast("int").alias("size"))
    postings = materialize(_shared_keys(postings, sim), "postings")
    edges = _scan(_blocks(postings, nodes), sim)
    names = linked_names(edges, nodes.drop("keys").withColumnRenamed("bits", "mark"),
                         lambda wanted: whole_sets(docs, wanted, doc_id, text, sim), sim,
                         lambda size, bits: Bitmaps(size, bits, sim))
    named = nodes.select("uid", "node", "first").join(names.withColumnRenamed("node", "uid"), "uid", "left").withColumn(
        "component", F.coalesce("component", "uid"))
    lead = F.min_by(F.struct("first", "uid"), F.struct(F.col("first").isNull(), "first", "uid"))
    leads = named.groupBy("component").agg(lead.alias("lead"))
    of_node = named.join(leads, "component").select("node", F.col("lead.first").alias("component_id"),
                                                    F.col("lead.uid").alias("lead"))
    return profiles.select("doc_id", "uid", "size", "node", "text_hash").join(of_node, "node", "left").select(
        "doc_id", "size", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash",
        F.coalesce(F.col("lead") == F.col("uid"), F.lit(True)).alias("leads"))

"""Sets of word shingles as sorted 64-bit hashes, and what a Jaccard similarity asks of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.llm import arrowtext


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words; linked when whole * intersection >= part * union."""
    words: int = 5
    part: int = 80
    whole: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.part * n // self.whole) + 1

    def slack(self, n, m):
        """Largest symmetric difference of linked sets of sizes n and m."""
        both = n + m
        return both - 2 * -(-self.part * both // (self.whole + self.part))

    def top(self, n):
        """Largest partner of a set of size n."""
        return n * self.whole // self.part

    def linked(self, n, m, both):
        return self.whole * both >= self.part * (n + m - both)


def shingle_sets(text: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its lower-cased shingles."""
    codes, dictionary, counts = arrowtext.word_codes(arrowtext.folded(text, arrowtext.LOWER))
    hashes = arrowtext.word_hashes(dictionary)[codes]
    windows = arrowtext.window_hashes(hashes, words)
    start = 0
    for n in counts.tolist():
        if n >= words:
            yield np.unique(windows[start:start + n - words + 1])
        elif n:
            yield arrowtext.window_hashes(hashes[start:start + n], n) ^ np.uint64(n)
        else:
            yield np.zeros(0, np.uint64)
        start += n


def digest(shingles: np.ndarray) -> bytes | None:
    import xxhash
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes()) if len(shingles) else None


def whole_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """(uid, set) of ``nodes`` (uid, node, first): the set of a document of id ``first`` whose digest is ``node``."""
    ids = nodes.select("first").distinct()
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text))
    source = source.join(ids, source["doc_id"].eqNullSafe(ids["first"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in arrowtext.text_slices(batches, text):
            found = [(digest(s), s.view(np.int64)) for s in shingle_sets(texts, sim.words) if len(s)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()),
                                                  pa.array([x for _, x in found], pa.list_(pa.int64()))], ["node", "set"])
    found = source.mapInArrow(run, "node binary, set array<long>").join(nodes.select("node", "uid"), "node")
    return found.dropDuplicates(["uid"]).select("uid", "set")

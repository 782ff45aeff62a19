"""Benchmark decontamination by an FM-index per shard of the training text.

A task cuts its documents into shards of a few MB, indexes each and searches all benchmark windows backward through
wavelet ranks. Found places become word spans, which are merged per document. Only stretches of words that the
benchmark knows are indexed, since no window reaches beyond them. The benchmark is the stated query set: it is sent to
the tasks in blocks of a bounded number of characters, one pass over the documents per block.

Edge cases: null and empty texts have no words and no hits; a benchmark item without words is never found; words that only
items without an id hold are hit, but such items are not among ``hit_items``; items of equal text or id are found together,
in order of id; a very long text is a shard of its own; repeated rows are judged row by row; without benchmark rows nothing is hit; extra columns pass through, but a column named like
a result (``n_words``, ``n_hit``, ``hit_items``, ``word_spans``, ``contaminated``) is replaced.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonecast.llm import arrowtext
from tonecast.llm.fmindex import FMIndex

WINDOW = 13
BLOCK_CHARS = 16 << 20
RESULTS = ("n_words", "word_spans", "hit_items")


class Phrases:
    """The windows of a block of items: symbols by length, and the items of each window."""

    def __init__(self, items: list[tuple[int | None, str]], width: int):
        text = pa.array([t or "" for _, t in items], pa.large_string())
        codes, self.vocabulary, counts = arrowtext.word_codes(arrowtext.folded(text, arrowtext.ALNUM))
        owners: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        start = 0
        for (item, _), n in zip(items, counts.tolist(), strict=True):
            words = (codes[start:start + n] + 1).tolist()
            start += n
            size = min(n, width)
            for i in range(n - size + 1 if n else 0):
                owners[size][tuple(words[i:i + size])].update([] if item is None else [item])
        self.groups = [(np.array(list(found), np.int64).reshape(-1, size), [sorted(x) for x in found.values()])
                       for size, found in sorted(owners.items())]
        self.shortest = min(owners, default=0)


def _stretches(symbols: np.ndarray, row: np.ndarray, shortest: int) -> np.ndarray:
    """Places of known words in stretches (within one row) of at least ``shortest`` words."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    known = symbols > 0
    cut = np.concatenate(([True], (known[1:] != known[:-1]) | (row[1:] != row[:-1])))
    run = np.cumsum(cut) - 1
    return np.flatnonzero(known & (np.bincount(run)[run] >= shortest))


def search_shard(text: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[list[int]], list[set]]:
    """Words per row, merged hit spans in words (flat start, end pairs) per row, and items found per row."""
    codes, words, counts = arrowtext.word_codes(arrowtext.folded(text, arrowtext.ALNUM))
    spans: list[list[int]] = [[] for _ in range(len(text))]
    found: list[set] = [set() for _ in range(len(text))]
    if not phrases.groups or not len(codes):
        return counts, spans, found
    known = pc.index_in(words, value_set=phrases.vocabulary.cast(words.type))
    symbols = (pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1)[codes]
    row = np.repeat(np.arange(len(text)), counts)
    first = np.cumsum(counts) - counts
    places = _stretches(symbols, row, phrases.shortest)
    if not len(places):
        return counts, spans, found
    ends = np.flatnonzero(np.concatenate(((np.diff(places) > 1) | (np.diff(row[places]) > 0), [True]))) + 1
    indexed, origin = np.insert(symbols[places], ends, 0), np.insert(places, ends, -1)
    index = FMIndex(indexed, len(phrases.vocabulary))
    edges = np.zeros(len(codes) + 1, np.int64)
    for patterns, owners in phrases.groups:
        low, high = index.find(patterns)
        many = high - low
        which = np.repeat(np.arange(len(patterns)), many)
        if not len(which):
            continue
        rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        at = origin[index.locate(rows)]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + patterns.shape[1], -1)
        for r, w in set(zip(row[at].tolist(), which.tolist(), strict=True)):
            found[r].update(owners[w])
    hit = np.cumsum(edges[:-1]) > 0
    start = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (row[1:] != row[:-1]))))
    end = np.flatnonzero(hit & np.concatenate((~hit[1:] | (row[1:] != row[:-1]), [True]))) + 1
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        spans[row[a]] += [a - int(first[row[a]]), b - int(first[row[a]])]
    return counts, spans, found


def merged(spans: list[int], more: list[int]) -> list[int]:
    """Union of two lists of flat spans; spans that touch become one."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2] + more[::2], spans[1::2] + more[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


_parsed: dict[str, Phrases] = {}


def _phrases(name: str, items: Broadcast, width: int) -> Phrases:
    """The worker's windows of a block; the tasks of a worker parse it once."""
    if name not in _parsed:
        _parsed.clear()
        _parsed[name] = Phrases(items.value, width)
    return _parsed[name]


def _pass(df: DataFrame, column: str, items: list[tuple[int, str]], width: int) -> DataFrame:
    shared, name = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(name, shared, width)
        for rows, text in arrowtext.text_slices(batches, column):
            counts, spans, found = search_shard(text, phrases)
            spans = [merged(a, b) if a else b for a, b in zip(rows.column("word_spans").to_pylist(), spans, strict=True)]
            found = [sorted(b.union(a)) for a, b in zip(rows.column("hit_items").to_pylist(), found, strict=True)]
            new = {"n_words": pa.array(counts.astype(np.int64)), "word_spans": pa.array(spans, pa.list_(pa.int32())),
                   "hit_items": pa.array(found, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(
                [new.get(name, rows.column(i)) for i, name in enumerate(rows.schema.names)], rows.schema.names)
    return df.mapInArrow(run, df.schema)


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in lists of about ``limit`` characters, one at a time."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    parts = int(size // limit) + 1
    for k in range(parts):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                 item_text: str = "text", width: int = WINDOW, one_in: int = 20,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents with n_words, n_hit, n_items, hit_items (long array), word_spans and contaminated.

    A document is contaminated when it has a hit and at least one in ``one_in`` of its words is hit.
    """
    out = docs.drop("n_hit", "n_items", "contaminated", *RESULTS).withColumns({
        "n_words": F.lit(0).cast("long"), "word_spans": F.array().cast(T.ArrayType(T.IntegerType())),
        "hit_items": F.array().cast(T.ArrayType(T.LongType()))})
    out = out.select(*(F.col(f"`{c}`") for c in out.columns))
    for block in _blocks(benchmark, item, item_text, block_chars):
        out = _pass(out, text, block, width)
    lengths = F.transform("word_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long"))
    return out.withColumns({"n_hit": F.aggregate(lengths, F.lit(0).cast("long"), lambda n, x: n + x),
                            "n_items": F.size("hit_items").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))

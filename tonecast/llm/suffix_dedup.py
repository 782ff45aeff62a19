"""Passages repeated across documents, found by sparse suffix arrays.

Only suffixes that start at minimisers are kept: the place of the smallest hash of each ``window`` of consecutive
words, so that a passage contains the same places wherever it stands. A passage of ``passage`` words holds a
minimiser among its first ``window`` words, behind which at least ``tail = passage - window + 1`` of its words follow.
The suffixes are sorted by these words, neighbours are compared, and only those whose words another text shares are
extended: to the left word by word over the places a passage around the minimiser could start at, to the right by the
overlap of the passages found. The extended suffixes are sorted and compared in the same way over all their words, so
the spans are exactly the words that lie in a run of ``passage`` words of another text.

Words are lower-cased (A-Z) and compared by 64-bit hashes. Texts that are equal word by word are one text: it is
searched once and its documents share the spans; held by several documents it is a repeated passage as a whole.

Edge cases: null, empty and short texts have no spans; repeated rows are copies of each other, and rows that share an id or
have none are told apart by their texts; very long texts are one row like any other; an empty table gives no row; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.llm import arrowtext
from tonecast.llm.runs import of_several
from tonecast.session import materialize

PASSAGE, WINDOW = 50, 25
SPANS = "array<struct<start: int, end: int>>"


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the last of equal ones) in each run of ``window`` words."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(arrowtext.mix64(hashes), window)[:, ::-1]
    return np.unique(np.arange(n) + window - 1 - views.argmin(axis=1))


def _hashed(texts: pa.Array) -> Iterator[np.ndarray]:
    codes, words, counts = arrowtext.word_codes(arrowtext.folded(texts, arrowtext.LOWER))
    hashes, start = arrowtext.word_hashes(words)[codes], 0
    for n in counts.tolist():
        yield hashes[start:start + n]
        start += n


def _suffixes(hashes: np.ndarray, passage: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes at minimisers and the hashes of their first ``passage - window + 1`` words."""
    tail = passage - window + 1
    at = minimisers(hashes, window)
    at = at[at + tail <= len(hashes)]
    return at, arrowtext.window_hashes(hashes, tail)[at].view(np.int64)


def _heads(docs: DataFrame, passage: int, window: int) -> DataFrame:
    """Per document uid, n_words, digest of the words and the distinct head hashes of its suffixes at minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        uid = TaskContext.get().partitionId() << 40
        for rows, texts in arrowtext.text_slices(batches):
            many, name, heads = [], [], []
            for h in _hashed(texts):
                many.append(len(h))
                name.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                heads.append(np.unique(_suffixes(h, passage, window)[1]))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(uid + np.arange(len(many))), pa.array(many, pa.int64()),
                 pa.array(name, pa.binary()), pa.array(heads, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "uid", "n_words", "words", "heads"])
            uid += len(many)
    return docs.mapInArrow(run, "doc_id long, text_hash long, uid long, n_words long, words binary, heads array<long>")


def _extended(docs: DataFrame, found: DataFrame, passage: int, window: int) -> DataFrame:
    """Runs of ``passage`` words that start up to ``window - 1`` words before a found suffix: hash, uid, start."""
    same = docs["doc_id"].eqNullSafe(found["id"]) & (docs["text_hash"] == found["found_hash"])
    source = docs.join(found, same, "inner").select("text", "uid", "words", "heads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for rows, texts in arrowtext.text_slices(batches):
            uids, names = rows.column(1).to_pylist(), rows.column(2).to_pylist()
            out = []
            for k, h in enumerate(_hashed(texts)):
                if xxhash.xxh3_128_digest(h.tobytes()) != names[k]:
                    continue  # another text of the same id and hash
                at, own = _suffixes(h, passage, window)
                at = at[np.isin(own, rows.column(3)[k].values.to_numpy())]
                starts = np.unique(at[:, None] - np.arange(window))
                starts = starts[(starts >= 0) & (starts + passage <= len(h))]
                if len(starts):
                    out.append((arrowtext.window_hashes(h, passage)[starts].view(np.int64),
                                np.full(len(starts), uids[k]), starts.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 ["hash", "uid", "start"])
    return source.mapInArrow(run, "hash long, uid long, start int")


def _spans(starts: DataFrame, passage: int) -> DataFrame:
    """Union of the runs of each text."""
    per = starts.groupBy("uid").agg(F.collect_set("start").alias("starts"))  # at most the words of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for x in batch.column(1).to_pylist():
                at = np.sort(np.array(x, np.int64))
                cut = np.flatnonzero(np.diff(at) > passage)
                first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + passage
                spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["uid", "spans"])
    return per.mapInArrow(run, f"uid long, spans {SPANS}")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, window: int = WINDOW, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Documents with repeated passages: doc_id, n_words, n_copies (documents of the same words) and spans in words."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    whole = materialize(_heads(source, passage, window), "suffixes").where(F.col("n_words") >= passage)
    texts = materialize(whole.groupBy("words").agg(F.min("uid").alias("uid"), F.count("*").alias("n_copies")), "texts")
    single = whole.select("uid", "heads").join(texts, "uid")
    suffixes = single.select(F.explode("heads").alias("head"), "uid")
    shared = of_several(suffixes, "head", "uid").groupBy("uid").agg(F.collect_list("head").alias("heads"))
    found = shared.join(whole.select("uid", F.col("doc_id").alias("id"), F.col("text_hash").alias("found_hash"), "words"), "uid")
    starts = of_several(materialize(_extended(source, found, passage, window), "extended"), "hash", "uid")
    spans = texts.join(_spans(starts, passage), "uid", "left").where("n_copies > 1 OR spans IS NOT NULL")
    out = whole.select("doc_id", "n_words", "words").join(spans.select("words", "n_copies", "spans"), "words")
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return out.select("doc_id", "n_words", "n_copies", F.when(F.col("n_copies") > 1, every).otherwise(F.col("spans")).alias("spans"))

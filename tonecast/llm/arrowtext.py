"""Whole-batch text handling inside Arrow tasks: byte folding, exact word dictionaries, bounded slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 4 << 20
BATCH_ROWS = 1_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z lower-cased; every other ASCII byte that is no letter or digit becomes a space.
ALNUM = bytes(_LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: A-Z lower-cased, nothing else changed.
LOWER = _LOWER


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches into runs of rows of about ``limit`` text bytes; a longer text is a slice of its own.

    Yields the rows and their texts (null: empty) as a large_string array of offset 0.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(text):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start), pa.concat_arrays([text.slice(start, stop - start)])
            start = stop
        pa.default_memory_pool().release_unused()
    release()


def release() -> None:
    """Give freed memory back at the end of a task: an executor's idle workers would keep it from the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Send tasks fewer rows at a time while the block runs its jobs; layout only."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, bytes]:
    """Byte offsets (rows + 1, from 0) and the joined UTF-8 of a large_string array."""
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset:text.offset + len(text) + 1]
    whole = data.to_pybytes() if data is not None else b""
    return at - at[0], whole[at[0]:at[-1]]


def folded(text: pa.Array, table: bytes) -> pa.Array:
    """Map every byte by ``table`` (only ASCII may change, so the result stays UTF-8 of the same length)."""
    at, data = raw_bytes(text)
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(at.astype(np.int64).tobytes()),
                                            pa.py_buffer(data.translate(table)))


def word_codes(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: a code per word, the dictionary of codes, words per row."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    rows = np.repeat(np.arange(len(text)), np.diff(lists.offsets.to_numpy()))
    coded = flat.filter(pa.array(full)).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, coded.dictionary, np.bincount(rows[full], minlength=len(text))


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps around)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per string, the same on every machine."""
    import xxhash
    at, data = raw_bytes(words.cast(pa.large_string()))
    ends = at.tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)),
                       np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix64(out * _PRIME + hashes[k:k + n] + np.uint64(k))
    return out

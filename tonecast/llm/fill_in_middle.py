"""Fill-in-middle documents: prefix, middle and suffix of whole lines in one of two orders.

A learned index tells where the k-th line of a document ends. Over all boundaries of a slice of documents segments of a line
are fitted greedily, each as long as some slope keeps every boundary within ``bound`` bytes; a cut is predicted from its
segment and corrected by the residual stored for its rank, so it is exact.

Edge cases: a null text is empty, and empty texts, texts that hold a marker and those left out by ``rate`` are plain; a
null id is hashed as no digits; repeated rows give equal rows; a text without line feeds is one line; very long texts are a
slice of their own; both cuts may fall on one boundary; an empty table gives no row; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonecast.llm import arrowtext

BOUND = 1000  # bytes; residuals take two bytes each
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


class RankIndex:
    """Rank of a boundary -> its offset, for offsets that never fall."""

    def __init__(self, offsets: np.ndarray, bound: int = BOUND):
        self.first, self.base, self.slope = [], [], []
        start = 0
        while start < len(offsets):
            low, high, stop, width = -np.inf, np.inf, start + 1, 64
            while stop < len(offsets):
                rise = offsets[stop:stop + width] - offsets[start]
                run = np.arange(stop - start, stop - start + len(rise))
                lows = np.maximum.accumulate(np.maximum((rise - bound) / run, low))
                highs = np.minimum.accumulate(np.minimum((rise + bound) / run, high))
                n = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else len(rise)
                if n:
                    low, high = float(lows[n - 1]), float(highs[n - 1])
                stop += n
                if n < len(rise):
                    break
                width *= 2
            self.first.append(start)
            self.base.append(int(offsets[start]))
            self.slope.append((low + high) / 2 if stop > start + 1 else 0.0)
            start = stop
        self.first, self.base, self.slope = np.array(self.first, np.int64), np.array(self.base, np.int64), np.array(self.slope)
        self.residual = (offsets - self.predicted(np.arange(len(offsets)))).astype(np.int16 if bound < 32_000 else np.int64)

    def predicted(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[at] + np.rint(self.slope[at] * (rank - self.first[at])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        return self.predicted(rank) + self.residual[rank]


def boundaries(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all line boundaries, text after text with its start, and each text's number of lines."""
    ends = np.flatnonzero(data == 10) + 1
    rows = np.arange(len(at) - 1)
    full = rows[at[1:] > at[:-1]]
    rest = full[data[at[full + 1] - 1] != 10]
    owner = np.concatenate((rows, np.searchsorted(at, ends - 1, side="right") - 1, rest))
    offsets = np.concatenate((at[:-1], ends, at[rest + 1]))
    return offsets[np.lexsort((offsets, owner))], np.bincount(owner, minlength=len(rows)) - 1


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, doc_id: str = "doc_id", text: str = "text",
              bound: int = BOUND) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars and output of every document.

    Cuts and form follow from the SHA-256 of seed and id: ``rate`` percent of the documents are rearranged, ``spm`` percent
    of them with the suffix first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in arrowtext.text_slices(batches, "text"):
            at, data = arrowtext.raw_bytes(texts)
            raw = np.frombuffer(data, np.uint8)
            offsets, n = boundaries(at, raw)
            index, top = RankIndex(offsets, bound), np.cumsum(n + 1) - (n + 1)
            h = [rows.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            first, last = (index.offset(top + cut) for cut in (np.minimum(one, two), np.maximum(one, two)))
            chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            out, form = [], []
            for k, (a, b, c, d) in enumerate(zip(at[:-1].tolist(), first.tolist(), last.tolist(), at[1:].tolist(), strict=True)):
                whole = data[a:d]
                if a == d or h[2][k] % 100 >= rate or any(x in whole for x in (PREFIX, SUFFIX, MIDDLE)):
                    form.append("plain")
                    out.append(whole)
                elif h[3][k] % 100 < spm:
                    form.append("spm")
                    out.append(SUFFIX + data[c:d] + PREFIX + data[a:b] + MIDDLE + data[b:c])
                else:
                    form.append("psm")
                    out.append(PREFIX + data[a:b] + SUFFIX + data[c:d] + MIDDLE + data[b:c])
            plain = np.array([f == "plain" for f in form], bool)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(chars[first] - chars[at[:-1]], pa.int64(), mask=plain),
                 pa.array(chars[last] - chars[first], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *groups)
    return source.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given (empty for null). Rearranged texts hold no marker of their own."""
    part = F.split(output, f"{PREFIX.decode()}|{SUFFIX.decode()}|{MIDDLE.decode()}", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))

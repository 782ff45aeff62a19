"""Language of a text by averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 2 to 4 bytes of the lower-cased text in which all but letters is blank. Embeddings and softmax
are trained together by stochastic gradient descent on a bounded sample of labelled documents; a part of the sample is
kept back to calibrate the scores (one temperature) and to set the score under which a prediction is not accepted.
Since both layers are linear, a prediction is the mean of one row of class weights per subword.

The sample holds an equal part of each language (all texts of a rare one), so no language stops being a class as a table
grows; its expected size is at most 1.1 times the larger of SAMPLE and LEAST times the languages. One row per language,
as many as the model has classes, is broadcast to pick it.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so is every text when there is nothing to
learn from; of languages with the same score the first by name is predicted; a text is read whole, whatever its length;
repeated rows are learned from once and predicted row by row; extra columns pass through, but columns named ``lang_pred``,
``score`` or ``accepted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonecast.llm import arrowtext

HASHED, WIDTH, ORDERS = 1 << 15, 16, (2, 3, 4)
STEPS = 24_000  # gradient steps, whatever the sample
SAMPLE = 6_000  # labelled texts to learn from, in equal parts per language
LEAST = 200  # texts of a language whatever the number of languages
PARTS = 16  # tasks that turn the sample into features
CHUNK = 1 << 20
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # hashed subwords x classes
    bias: np.ndarray
    temperature: float
    accept: float


def subwords(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and hashed subword of every place in the texts, in bounded chunks."""
    at, data = arrowtext.raw_bytes(pc.utf8_lower(text))
    byte = np.frombuffer(data.translate(_LETTERS), np.uint8)
    for start in range(0, len(byte), CHUNK):
        own = byte[start:start + CHUNK + max(ORDERS)].astype(np.uint32)
        row = np.searchsorted(at, np.arange(start, start + len(own)), side="right") - 1
        h = np.zeros(len(own), np.uint32)
        for k in range(max(ORDERS)):
            h = h[:len(own) - k] * np.uint32(0x01000193) ^ own[k:] if k else own.copy()
            n = k + 1
            if n in ORDERS and len(h):
                stop = min(len(h), CHUNK)
                mixed = h[:stop] * np.uint32(0x9E3779B1) + np.uint32(n)
                inside = (row[:stop] == row[k:k + stop]) & (own[1:1 + stop] != 32)
                yield row[:stop][inside], ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(HASHED)).astype(np.int64)[inside]


def learn(texts: list[tuple[str, np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = 4.0, seed: int = 5) -> Model | None:
    """Train on (class, subword ids, subword counts), one text a step; every fifth text calibrates."""
    classes = sorted({c for c, _, _ in texts})
    fitted = [(classes.index(c), i, (n / n.sum()).astype(np.float32)) for c, i, n in texts if len(i)]
    if not fitted:
        return None
    rng = np.random.default_rng(seed)
    held, train = fitted[::5], [x for k, x in enumerate(fitted) if k % 5] or fitted
    e = rng.normal(0, 0.1, (HASHED, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    rounds = -(-steps // len(train))
    for turn, k in enumerate(np.concatenate([rng.permutation(len(train)) for _ in range(rounds)])[:steps]):
        c, i, n = train[k]
        step = rate * (1 - turn / steps)
        mean = n @ e[i]
        p = _softmax((mean @ w + b)[None])[0]
        p[c] -= 1
        back = w @ p
        w -= 0.1 * step * np.outer(mean, p)
        b -= 0.01 * step * p
        e[i] -= step * n[:, None] * back[None]
    weights = e @ w
    logits = np.array([n @ weights[i] + b for _, i, n in held])
    truth = np.array([c for c, _, _ in held])
    grid = np.geomspace(0.02, 20, 61)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    chance = _softmax(logits / temperature)
    order = np.argsort(-chance.max(axis=1))
    wrong = np.cumsum(chance.argmax(axis=1)[order] != truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(wrong <= 0.01)  # accept as far down as one in a hundred is wrong
    accept = float(chance.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return Model(classes, weights, b, temperature, accept)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sampled(labelled: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """Distinct (_text, _label) to learn from: of each language all, or in expectation its part of ``sample``.

    A language's part is an equal one, but ``least`` texts at any rate, so that rare languages stay classes at every
    size. Texts are counted (to about 5 %) and picked by a hash of the text, so copies neither count nor crowd.
    """
    rows = labelled.select(F.col(text).alias("_text"), F.col(label).cast("string").alias("_label"),
                           F.xxhash64(F.lit(29), text).alias("_h")).where("_label IS NOT NULL AND _text IS NOT NULL")
    texts = rows.groupBy("_label").agg(F.approx_count_distinct("_h", 0.05).alias("_n"))
    bound = F.greatest(F.lit(least), F.floor(F.lit(sample) / F.count("*").over(Window.partitionBy())))
    share = texts.select(F.col("_label").alias("_l"), F.least(F.lit(1.0), 1.1 * bound / F.greatest("_n", F.lit(1))).alias("_share"))
    spot = F.pmod(F.col("_h"), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.join(F.broadcast(share), F.col("_label") == F.col("_l")).where(spot < F.col("_share"))
    # copies go before anything is dealt by the text, then the bounded sample is spread
    return picked.dropDuplicates(["_h", "_label"]).repartition(PARTS, "_h").select("_text", "_label")


def train(labelled: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE, least: int = LEAST) -> Model | None:
    """Learn from a bounded sample (see ``sampled``) of the rows with a label."""
    picked = sampled(labelled, text, label, sample, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrowtext.text_slices(batches, "_text", CHUNK):
            seen = [np.zeros(0, np.int64)]
            for row, h in subwords(texts):
                seen.append(row * HASHED + h)
            ids, counts = np.unique(np.concatenate(seen), return_counts=True)
            cuts = np.searchsorted(ids, np.arange(1, len(texts)) * HASHED)
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array([x.astype(np.int32).tobytes() for x in np.split(ids % HASHED, cuts)]),
                 pa.array([x.astype(np.int32).tobytes() for x in np.split(counts, cuts)])], ["label", "ids", "counts"])
    found = picked.mapInArrow(run, "label string, ids binary, counts binary").collect()
    read = lambda x: np.frombuffer(bytes(x), np.int32)
    return learn([(r.label, read(r.ids), read(r.counts)) for r in sorted(found, key=lambda r: (r.label, bytes(r.ids)))])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add lang_pred, score (calibrated, 0 to 1) and accepted."""
    plain = docs.drop("lang_pred", "score", "accepted", "_letter")
    if model is None:
        return plain.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "accepted": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = plain.columns
    source = plain.withColumn("_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields]
                       + ["lang_pred string, score double, accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in arrowtext.text_slices(batches, text):
            total, many = np.zeros((len(texts), len(m.classes))), np.zeros(len(texts))
            for row, h in subwords(texts):
                many += np.bincount(row, minlength=len(texts))
                for c in range(len(m.classes)):
                    total[:, c] += np.bincount(row, m.weights[:, c][h], minlength=len(texts))
            chance = _softmax((total / np.maximum(many, 1)[:, None] + m.bias) / m.temperature)
            letter = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best, score = chance.argmax(axis=1), np.where(letter, chance.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(names))),
                 pa.array([m.classes[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]),
                 pa.array(score), pa.array(letter & (score >= m.accept))], [*names, "lang_pred", "score", "accepted"])
    return source.mapInArrow(run, schema)
